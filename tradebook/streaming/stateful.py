"""Streaming forms of the sequential decisions: the same steps as the batch runs, in event time.

Streams need a watermarked TIMESTAMP column ``ts`` beside the columns of the batch form; seconds
are taken from it. A decision depends on all earlier rows of its key, and rows come late and in any
order. So a row waits until the watermark has passed its stretch (``SETTLE_SECONDS``): then every
row of the stretch is known, and a timer decides it in (t, event_id) order. Rows behind the watermark
are dropped by Spark. Waiting rows lie in state in sorted blocks of ``BLOCK_ROWS``, and one timer decides all
that the watermark has passed: calls to the state grow with blocks, not with rows or stretches. A task holds
the blocks that overlap in time, whatever the key's size. State is cleared by a timer once the watermark has
passed everything it could still influence.

Rows of a fold are packed before they are shuffled: the tasks that read them put up to ``PACKED_ROWS`` rows of one
key and span into one, so that a hot key's task unpacks lists and does not take rows from Spark one by one. Spark
drops a pack when all of it is behind the watermark; rows before what their key has decided are dropped here.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tradebook.operators import limits as L
from tradebook.operators.keyed import with_rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that are decided together, in seconds of event time: a decision comes that much later at most.
#: A sixth of the rule's memory where that is more.
SETTLE_SECONDS = 60

#: Waiting rows of one entry in state. A batch of rows from Spark (10,000) gives some 20 blocks, so that blocks of
#: rows in no order at all overlap with a tenth of the waiting rows.
BLOCK_ROWS = 512

#: Rows that are shuffled as one, and the longest span they come from where the rule's memory sets none.
PACKED_ROWS = 128
PACKED_SECONDS = 3600

#: Decided rows that are handed on together.
OUT_ROWS = 10_000

#: Groups of keys whose writes are kept together by expire_stream. Fixed: state is found again by them.
EXPIRY_SHARDS = 256


class _Waiting(StatefulProcessor):
    """Rows wait in state until the watermark has passed their stretch, then they come in order.

    ``inputs`` begin with t and event_id; ``whole`` tells which are whole numbers (a null among them makes
    pandas use floats). Rows without a time are left out.
    """

    def __init__(self, inputs: Sequence[str], whole: Sequence[bool], names: Sequence[str], settle: int):
        self.inputs, self.whole, self.names, self.settle = list(inputs), list(whole), list(names), settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getValueState("blocks", "n bigint")
        self.waiting = handle.getMapState("waiting", "first bigint, block bigint", "body binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            found = self._tuples(frame[frame["t"].notna()])
            if found:
                self._wait(found)
                first = found[0][0] if first is None else min(first, found[0][0])
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=self.names)

    def _tuples(self, frame: pd.DataFrame) -> list[tuple]:
        columns = []
        for name, whole in zip(self.inputs, self.whole, strict=True):
            values = frame[name].tolist()
            # rows of other keys may hold the nulls that make these numbers floats
            if frame[name].hasnans or whole and frame[name].dtype.kind != "i":
                values = [None if pd.isna(v) else int(v) if whole else v for v in values]
            columns.append(values)
        return sorted(zip(*columns, strict=True), key=_order)

    def _wait(self, rows: list[tuple]) -> None:
        known = self.blocks.get()
        n = int(known[0]) if known else 0
        for at in range(0, len(rows), BLOCK_ROWS):
            some = rows[at:at + BLOCK_ROWS]
            self.waiting.updateValue((some[0][0], n), (pickle.dumps(some),))
            n += 1
        self.blocks.update((n,))

    def _wake(self, t: int) -> None:
        self.handle.registerTimer((t // self.settle + 1) * self.settle * 1000)

    def _passed(self, before: int) -> Iterator[list[tuple]]:
        """The waiting rows before a time, in order, taken out of state."""
        known = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        due = known[:bisect_left(known, (before,))]
        held: list[tuple] = []
        at = 0
        while at < len(due):
            # as many rows as are held, so that each is sorted a few times only
            fresh: list[tuple] = []
            while at < len(due) and len(fresh) < max(len(held), OUT_ROWS):
                fresh += pickle.loads(bytes(self.waiting.getValue(due[at])[0]))
                self.waiting.removeKey(due[at])
                at += 1
            held = sorted(held + fresh, key=_order)
            # blocks lie in order of their first rows: all rows before the next one's are held
            cut = bisect_left(held, due[at][0] if at < len(due) else before, key=lambda r: r[0])
            for start in range(0, cut, OUT_ROWS):
                yield held[start:min(start + OUT_ROWS, cut)]
            held = held[cut:]
        if held:
            self._wait(held)
        later = [held[0][0]] if held else []
        if len(known) > len(due):
            later.append(known[len(due)][0])
        if later:
            self._wake(min(later))
        elif known:
            self.blocks.clear()

    def _settled(self, timerValues) -> int:
        """Every row before this second is known."""
        return timerValues.getCurrentWatermarkInMs() // 1000 // self.settle * self.settle

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    return row[0], row[1]


def _step(memory: int, settle: int) -> int:
    """Whole stretches of a memory; a key is forgotten one or two of these after its memory has ended."""
    return max(memory // settle, 1) * settle


class _Fold(_Waiting):
    """Steps along each key in event time."""

    def __init__(self, inputs: Sequence[str], whole: Sequence[bool], names: Sequence[str],
                 start: Callable[[], dict], step: Callable[..., tuple], memory: int | None, settle: int,
                 keep: Callable[[tuple], bool] | None = None):
        super().__init__(inputs, whole, names, settle)
        self.start, self.step, self.memory, self.keep = start, step, memory, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "forget_at bigint, body string")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, last = self.state.get(), None
        forget, state = (int(held[0]), json.loads(held[1])) if held else (0, self.start())
        for rows in self._passed(self._settled(timerValues)):
            last = rows[-1][0]
            out = []
            for row in rows:
                made = self.step(state, *row)
                if self.keep is None or self.keep(made):
                    out.append((*key, *row, *made))
            yield pd.DataFrame(out, columns=self.names)
        if last is not None:
            if self.memory is not None:
                # counted in steps of the memory, so that a busy key has one such timer at a time
                step = _step(self.memory, self.settle)
                due = ((last + self.memory) // step + 2) * step
                if due != forget:
                    forget = due
                    self.handle.registerTimer(due * 1000)
            self.state.update((forget, json.dumps(state)))
        elif held and self.memory is not None and forget <= expiredTimerInfo.getExpiryTimeInMs() // 1000:
            self.state.clear()


class _PackedFold(_Fold):
    """A fold of rows that come packed.

    A pack that Spark lets in may begin before the watermark. Its rows count as long as their key has decided
    nothing after them; once a key's state is forgotten, a pack is too short to reach back into its memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.decided = handle.getValueState("decided", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.decided.get()
        first = None
        for some in self._unpacked(rows, int(known[0]) if known else None):
            self._wait(some)
            first = some[0][0] if first is None else min(first, some[0][0])
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=self.names)

    def _unpacked(self, frames: Iterator[pd.DataFrame], since: int | None) -> Iterator[list[tuple]]:
        fresh: list[tuple] = []
        for frame in frames:
            for body in frame["body"]:
                rows = pickle.loads(bytes(body))
                fresh += rows if since is None or rows[0][0] >= since else [r for r in rows if r[0] >= since]
                if len(fresh) >= OUT_ROWS:
                    yield sorted(fresh, key=_order)
                    fresh = []
        if fresh:
            yield sorted(fresh, key=_order)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.state.get():
            self.decided.update((self._settled(timerValues),))
        else:
            self.decided.clear()


def _packed(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], span: int) -> DataFrame:
    """Rows (keys, ts, inputs) as (keys, ts, body): sorted lists of rows of one key and span under their last ts.

    ``inputs`` begin with t and event_id. Rows without a time are left out.
    """
    keys, inputs = list(keys), list(inputs)
    # the field of ts says that it is the watermarked column
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType, True) for k in keys]) \
        .add(rows.schema["ts"]).add("body", T.BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stamps = batch.column("ts").cast(pa.int64()).to_pylist()
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            found = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            spans: dict[tuple, list[tuple]] = {}
            for name, row, stamp in zip(names, found, stamps, strict=True):
                if row[0] is not None:
                    spans.setdefault((name, row[0] // span), []).append((row[0], row[1], stamp, row))
            out = []
            for (name, _), some in spans.items():
                some.sort(key=_order)
                for at in range(0, len(some), PACKED_ROWS):
                    pack = some[at:at + PACKED_ROWS]
                    out.append((*name, max(r[2] for r in pack), pickle.dumps([r[3] for r in pack])))
            columns = list(zip(*out, strict=True)) or [()] * (len(keys) + 2)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, batch.schema.field(k).type) for k, c in zip(keys, columns, strict=False)),
                 pa.array(columns[-2], pa.int64()).cast(batch.schema.field("ts").type), pa.array(columns[-1], pa.binary())],
                names=[*keys, "ts", "body"])

    return rows.select(*keys, "ts", *inputs).mapInArrow(pack, schema)


def _fold_stream(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], start, step, outputs: str,
                 memory: int | None, keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """Steps along each key; of their results only those that ``keep`` names leave the task."""
    settle = max(SETTLE_SECONDS, (memory or 0) // 6)
    _use_rocksdb(df)
    rows = df.withColumn("t", F.unix_seconds("ts"))
    schema = T.StructType([rows.schema[c] for c in (*keys, *inputs)] + list(T._parse_datatype_string(outputs).fields))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    # at most the time between the end of a key's memory and its being forgotten
    packs = _packed(rows, keys, inputs, PACKED_SECONDS if memory is None else _step(memory, settle))
    return packs.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_PackedFold(inputs, _whole(rows, inputs), schema.fieldNames(), start, step, memory, settle, keep),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _use_rocksdb(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _whole(df: DataFrame, names: Sequence[str]) -> list[bool]:
    return [isinstance(df.schema[c].dataType, T.IntegralType) for c in names]


def limit_rate_stream(requests: DataFrame, rules: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Decision per request, as limit_rate."""
    from tradebook import fixed

    ruled = with_rule(requests, rules)
    memory = max(max(r[1], r[2]) for r in (rules or fixed.RATE_RULES).values())

    def step(state, t, event_id, limit, period, penalty):
        was_blocked = state["blocked"] is not None and t < state["blocked"]
        admitted, violated = L.limit_step(state, t, 1, limit, period, penalty)
        return ("admitted" if admitted else "blocked" if was_blocked or not violated else "limited",)

    out = _fold_stream(ruled, ["rule", "domain"], ["t", "event_id", "max_requests", "period", "penalty"],
                       L.limit_start, step, "decision string", memory)
    return out.select("event_id", "t", "rule", "domain", "decision")


def limit_sliding_stream(requests: DataFrame, key: str, n: int = 10, window: int = 60) -> DataFrame:
    def step(state, t, event_id):
        return (L.limit_step(state, t, 1, n, window, 0)[0] == 1,)

    return _fold_stream(requests, [key], ["t", "event_id"], L.limit_start, step, "allowed boolean", window) \
        .select("event_id", "t", key, "allowed")


def lockouts_stream(attempts: DataFrame, max_failed: int = 5, window: int = 1800, duration: int = 300) -> DataFrame:
    """Outcome per attempt, as lockouts."""
    def step(state, t, event_id, success):
        acted, locked = L.lockout_step(state, t, 1, 0 if success else 1, success, 0, 0, max_failed, window, duration)
        return ("ignored" if not acted else "lockout" if locked else "success" if success else "failure",)

    out = _fold_stream(attempts, ["username"], ["t", "event_id", "success"], L.lockout_start, step,
                       "outcome string", max(window, duration))
    return out.select("event_id", "t", "username", "success", "outcome")


def alerts_stream(events: DataFrame, threshold: int = 5, window: int = 300, expiry: int | None = None) -> DataFrame:
    """Recorded alerts, as alerts_with_dedup.

    With ``expiry`` an alert counts for so many seconds and a message that stays quiet that long is forgotten;
    without it a message's count never expires, and neither does its state.
    """
    def step(state, t, event_id, severity):
        return L.alert_step(state, t, severity, threshold, window, expiry)

    out = _fold_stream(events, ["message"], ["t", "event_id", "severity"], L.alert_start, step,
                       "count bigint, notified boolean", expiry, lambda made: made[0] is not None)
    return out.filter(F.col("count").isNotNull()).select("event_id", "t", "message", "severity", "count", "notified")


def match_pattern_stream(events: DataFrame, types: Sequence[str], within: int, by: str, ordered: bool = True,
                         metadata=None, reuse_completing_event: bool = False) -> DataFrame:
    """Completed patterns, as match_pattern."""
    fitting = events.filter(F.col("type").isin(list(types)))
    if metadata is not None:
        fitting = fitting.filter(metadata)

    def step(state, t, event_id, kind):
        return L.pattern_step(state, t, event_id, kind, types, within, ordered, reuse_completing_event)

    out = _fold_stream(fitting, [by], ["t", "event_id", "type"], L.pattern_start, step,
                       "start_t bigint, event_ids array<bigint>", within, lambda made: made[0] is not None)
    return out.filter(F.col("start_t").isNotNull()).select(by, "start_t", F.col("t").alias("end_t"), "event_ids")


def cooldown_stream(raised: DataFrame, cooldown: int = 300) -> DataFrame:
    """Rule alerts (event_id, ts, rule_name, severity, message) with the cooldown of threshold_rules."""
    def step(state, t, event_id, severity, message):
        if state.get("fired") is not None and t - state["fired"] < cooldown:
            return (False,)
        state["fired"] = t
        return (True,)

    out = _fold_stream(raised, ["rule_name"], ["t", "event_id", "severity", "message"], dict, step,
                       "kept boolean", cooldown, lambda made: made[0])
    return out.filter("kept").select("rule_name", "t", "severity", "message")


class _Expiry(_Waiting):
    """Keeps the last write of each key of a group and reports those that run out unreplaced."""

    def __init__(self, keys: Sequence[str], inputs: Sequence[str], whole: Sequence[bool], settle: int):
        super().__init__(inputs, whole, [*keys, "expires_at"], settle)
        self.at = [self.inputs.index(k) for k in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.live = handle.getValueState("live", "body binary")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, before = self.live.get(), self._settled(timerValues)
        live = pickle.loads(bytes(held[0])) if held else {}
        most = 2 * len(live) + OUT_ROWS
        for rows in self._passed(before):
            out = []
            for row in rows:
                t, expires, name = row[0], row[2], tuple(row[n] for n in self.at)
                old = live.pop(name, None)
                if old is not None and old < t:
                    out.append((*name, old))
                if expires is not None and expires >= t:
                    live[name] = expires
            if len(live) > most:
                out += self._run_out(live, rows[-1][0])
                most = 2 * len(live) + OUT_ROWS
            yield pd.DataFrame(out, columns=self.names)
        yield pd.DataFrame(self._run_out(live, before), columns=self.names)
        if live:
            self.live.update((pickle.dumps(live),))
            self._wake(min(live.values()))
        elif held:
            self.live.clear()

    def _run_out(self, live: dict, before: int) -> list[tuple]:
        """Writes that ran out before a time up to which every write is known."""
        gone = [(*name, expires) for name, expires in live.items() if expires < before]
        for name in gone:
            del live[name[:-1]]
        return gone


def expire_stream(writes: DataFrame, keys: Sequence[str], ttl: str = "ttl") -> DataFrame:
    """(keys, expires_at) of every write that runs out before its key is written again.

    A write at second t lives ``ttl`` seconds (NULL: for ever). Decisions wait for the watermark, so late rows
    inside it count, in any order; a key's state is dropped when its last write has run out. Keys are kept in
    ``EXPIRY_SHARDS`` groups by their hash, so that millions of keys are not as many calls to Python.
    """
    _use_rocksdb(writes)
    rows = writes.withColumn("t", F.unix_seconds("ts")).withColumn("expires_at", F.col("t") + F.col(ttl)) \
        .withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(EXPIRY_SHARDS)))
    inputs = list(dict.fromkeys(["t", "event_id", "expires_at", *keys]))
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType, True) for k in keys]).add("expires_at", T.LongType())
    return rows.select("_shard", "ts", *inputs).groupBy("_shard").transformWithStateInPandas(
        statefulProcessor=_Expiry(keys, inputs, _whole(rows, inputs), 1),
        outputStructType=schema, outputMode="Append", timeMode="EventTime")
