"""Streams over several micro-batches give the batch result."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tradebook.operators import keyed, limits
from tradebook.plans.scale import spaced
from tradebook.streaming import flows, stateful

BASE = 1704067200


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Many small micro-batches: a task for each partition is most of their time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write_parts(spark, path, df, by="t", parts=4, late=0, end=True):
    """Files that arrive one a micro-batch; with ``late`` rows come up to so many seconds late, in any order.

    With ``end`` the last file holds one row far in the future, which moves the watermark past all others.
    """
    arrives = F.col(by) + (F.abs(F.xxhash64("event_id")) % late if late else F.lit(0))
    timed = df.withColumn("_a", arrives)
    lo, hi = timed.agg(F.min("_a"), F.max("_a")).first()
    width = (hi - lo) // parts + 1
    stamped = timed.withColumn("ts", F.timestamp_seconds(F.col(by) + BASE))
    for k in range(parts):
        stamped.filter((F.col("_a") >= lo + k * width) & (F.col("_a") < lo + (k + 1) * width)) \
            .orderBy(F.rand(k)).drop("_a").coalesce(1).write.parquet(f"{path}/p{k}")
        time.sleep(0.02)        # files are read in order of their age
    if end:
        last = df.orderBy(F.desc(by)).limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), by: F.col(by) + 10 * 86400})
        last.withColumn("ts", F.timestamp_seconds(F.col(by) + BASE)).coalesce(1).write.parquet(f"{path}/p{parts}")


def stream(spark, path, df):
    like = df.withColumn("ts", F.timestamp_seconds("t"))
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(path).withWatermark("ts", "5 minutes")


def rows(df, *times):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c] - BASE if c in times else r[c]) for c in cols) for r in df.collect())


def make(spark, n, seed, span, names, values):
    rnd = random.Random(seed)
    data = sorted(rnd.randint(0, span) for _ in range(n))
    return spark.createDataFrame([(k, t, rnd.choice(names), rnd.choice(values)) for k, t in enumerate(data)],
                                 "event_id bigint, t bigint, a string, b string")


#: Rows come up to 250 of the 300 seconds late that the watermark allows; the stream queries run in order.
LATE = 250


def test_rate_limits(spark, tmp_path):
    df = make(spark, 600, 1, 2000, ["hot", "hot", "d1"], ["scrape", "other"]).withColumnsRenamed({"a": "domain", "b": "rule"})
    write_parts(spark, f"{tmp_path}/r", df, parts=6, late=LATE)
    out = flows.run_available(stateful.limit_rate_stream(stream(spark, f"{tmp_path}/r", df)))
    assert rows(out, "t") == rows(limits.limit_rate(df))
    out = flows.run_available(stateful.limit_sliding_stream(stream(spark, f"{tmp_path}/r", df), "domain", 5))
    assert rows(out, "t") == rows(limits.limit_sliding(df, "domain", 5))


def test_lockouts(spark, tmp_path):
    tries = make(spark, 500, 2, 9000, ["u1", "u2"], ["y", "n", "n", "n"]).select(
        "event_id", "t", F.col("a").alias("username"), (F.col("b") == "y").alias("success"))
    write_parts(spark, f"{tmp_path}/l", tries, late=LATE)
    out = flows.run_available(stateful.lockouts_stream(stream(spark, f"{tmp_path}/l", tries)))
    assert rows(out, "t") == rows(limits.lockouts(tries))


def test_alerts(spark, tmp_path):
    ev = make(spark, 600, 3, 4000, ["m1", "m2"], ["error", "info"]).withColumnsRenamed({"a": "message", "b": "severity"})
    write_parts(spark, f"{tmp_path}/a", ev, late=LATE)
    out = flows.run_available(stateful.alerts_stream(stream(spark, f"{tmp_path}/a", ev)))
    assert rows(out, "t") == rows(limits.alerts_with_dedup(ev))
    out = flows.run_available(stateful.alerts_stream(stream(spark, f"{tmp_path}/a", ev), 3, 60, 200))
    expect = rows(limits.alerts_with_dedup(ev, 3, 60, expiry=200, chunk_seconds=500))
    assert rows(out, "t") == expect and expect != rows(limits.alerts_with_dedup(ev, 3, 60))


def test_patterns(spark, tmp_path):
    pt = make(spark, 600, 4, 4000, ["n1", "n2"], ["A", "B", "C"]).withColumnsRenamed({"a": "node_id", "b": "type"})
    write_parts(spark, f"{tmp_path}/p", pt, late=LATE)
    out = flows.run_available(stateful.match_pattern_stream(stream(spark, f"{tmp_path}/p", pt), ["A", "B"], 20, "node_id"))
    assert rows(out, "start_t", "end_t") == rows(limits.match_pattern(pt, ["A", "B"], 20, "node_id"))


def test_cooldowns(spark, tmp_path):
    raised = make(spark, 400, 8, 4000, ["r1", "r2", "r2"], ["w", "c"]).withColumnsRenamed({"a": "rule_name", "b": "severity"}) \
        .dropDuplicates(["rule_name", "t"]).withColumn("message", F.concat("rule_name", F.lit(" fired")))
    write_parts(spark, f"{tmp_path}/c", raised, late=LATE)
    out = flows.run_available(stateful.cooldown_stream(stream(spark, f"{tmp_path}/c", raised), 100))
    assert rows(out.select("rule_name", "t"), "t") == rows(spaced(raised, ["rule_name"], "t", "event_id", 100).select("rule_name", "t"))


def test_forgotten_state_makes_no_difference(spark, tmp_path):
    """Bursts far apart: a key's state is cleared between them and decisions stay those of the batch."""
    rnd = random.Random(9)
    df = spark.createDataFrame([(k, (k // 60) * 5000 + rnd.randrange(40), "d", "scrape") for k in range(240)],
                               "event_id bigint, t bigint, domain string, rule string")
    write_parts(spark, f"{tmp_path}/r", df, parts=4)
    out = flows.run_available(stateful.limit_rate_stream(stream(spark, f"{tmp_path}/r", df)))
    assert rows(out, "t") == rows(limits.limit_rate(df))


def test_repeated_alerts_of_one_second(spark):
    """Expiring counts with many rows a second, against the steps row by row."""
    rnd = random.Random(10)
    data = [(k, rnd.randrange(60) * 20, "m", rnd.choice(["error", "info"])) for k in range(900)]
    ev = spark.createDataFrame(data, "event_id bigint, t bigint, message string, severity string")
    state, expect = limits.alert_start(), []
    for k, t, m, s in sorted(data, key=lambda r: (r[1], r[0])):
        count, notified = limits.alert_step(state, t, s, 4, 50, 70)
        if count is not None:
            expect.append((k, t, m, s, count, notified))
    got = limits.alerts_with_dedup(ev, 4, 50, chunk_seconds=100, expiry=70)
    assert sorted(map(tuple, got.collect())) == sorted(expect)


def test_dedup_and_snapshots(spark, tmp_path):
    df = make(spark, 200, 5, 900, ["x", "Y "], ["1", "2"]).withColumnsRenamed({"a": "business_name", "b": "address"})
    write_parts(spark, f"{tmp_path}/d", df, end=False)
    reader = spark.readStream.schema(df.withColumn("ts", F.timestamp_seconds("t")).schema).option("recursiveFileLookup", True)
    out = flows.run_available(flows.dedup_stream(reader.parquet(f"{tmp_path}/d")).select("business_key"))
    assert sorted(r[0] for r in out.collect()) == ["x|1", "x|2", "y|1", "y|2"]

    log = make(spark, 100, 6, 400, ["k1", "k2"], ["SET", "GET"]).withColumnsRenamed({"a": "cache_key", "b": "type"})
    write_parts(spark, f"{tmp_path}/s", log, end=False)
    table = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "cache_key string, v int")
    flows.snapshot_on_batch(stream(spark, f"{tmp_path}/s", log), lambda: table, f"{tmp_path}/snap", f"{tmp_path}/ck").awaitTermination()
    snap = spark.read.parquet(f"{tmp_path}/snap/*").distinct()
    assert sorted(r["cache_key"] for r in snap.collect()) == ["k1", "k2"]
    restored = keyed.restore_snapshot(table.withColumn("v", F.lit(0)), snap)
    assert {r["cache_key"]: r["v"] for r in restored.collect()} == {"k1": 1, "k2": 2, "k3": 0}


def test_priority_routing(spark, tmp_path):
    log = make(spark, 60, 7, 400, ["k"], ["ERROR", "WARNING", "GET"]).withColumnsRenamed({"a": "cache_key", "b": "type"})
    write_parts(spark, f"{tmp_path}/s", log, end=False)
    flows.route_by_priority(stream(spark, f"{tmp_path}/s", log), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("type", "priority").count().collect()
    assert {(r["type"], r["priority"]) for r in got} == {("ERROR", "HIGH"), ("WARNING", "MEDIUM"), ("GET", "LOW")}


class Kept:
    """State, timers and a count of the calls to them, in the place of Spark's."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, *schema):
        return KeptState(self, name)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


class KeptState:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def _of(self, key=()):
        self.kept.calls += 1
        return self.name, tuple(key)

    def get(self, key=()):
        return self.kept.values.get(self._of(key))

    def clear(self, key=()):
        self.kept.values.pop(self._of(key), None)

    def keys(self):
        return [k for n, k in list(self.kept.values) if n == self.name]

    def update(self, value):
        self.kept.values[self._of()] = value

    def updateValue(self, key, value):
        self.kept.values[self._of(key)] = value

    getValue, removeKey = get, clear


class Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


@pytest.mark.parametrize("shuffled", [False, True])
def test_calls_to_state_grow_with_blocks(shuffled):
    """Every row in a stretch of its own: all come in order, with far fewer calls to the state than rows."""
    import pandas as pd
    frame = pd.DataFrame({"t": [k * 100 for k in range(20_000)], "event_id": range(20_000)})
    given = frame.sample(frac=1, random_state=1) if shuffled else frame
    fold = stateful._Fold(["t", "event_id"], [True, True], ["k", "t", "event_id", "n"], lambda: {"n": 0},
                          lambda state, t, event_id: (state.update(n=state["n"] + 1) or state["n"],), 300, 60)
    kept = Kept()
    fold.init(kept)
    list(fold.handleInputRows(("a",), iter([given[:10_000], given[10_000:]]), None))
    half = list(fold.handleExpiredTimer(("a",), Mark(1_000_000_000), Mark(min(kept.timers))))
    rest = list(fold.handleExpiredTimer(("a",), Mark(9_000_000_000), Mark(min(kept.timers))))
    assert pd.concat(half)["event_id"].tolist() == list(range(10_000))          # 999,960 seconds are settled
    assert pd.concat(rest)["event_id"].tolist() == list(range(10_000, 20_000))
    assert pd.concat(rest)["n"].tolist() == list(range(10_001, 20_001))
    assert kept.calls < 400 and not [k for k in kept.values if k[0] != "state"]


def test_rows_are_packed_before_they_are_shuffled(spark):
    """A hot and a null key: all rows but those without a time come in few packs, each short in rows and seconds."""
    import pickle
    df = spark.range(0, 20_000, 1, 3).select(
        F.when(F.col("id") % 50 > 0, "hot").alias("k"), F.timestamp_seconds(F.col("id") + 0.25).alias("ts"),
        F.when(F.col("id") % 1000 > 0, F.col("id")).alias("t"), F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("b"))
    packs = stateful._packed(df, ["k"], ["t", "event_id", "b"], 300).collect()
    got = []
    for p in packs:
        held = pickle.loads(bytes(p["body"]))
        assert held == sorted(held, key=lambda r: r[:2]) and len(held) <= stateful.PACKED_ROWS
        assert len({t // 300 for t, _, _ in held}) == 1 and int(p["ts"].timestamp()) == held[-1][0]
        got += [(p["k"], *r) for r in held]
    expect = [(r["k"], r["t"], r["event_id"], r["b"]) for r in df.filter("t IS NOT NULL").collect()]
    assert sorted(got, key=lambda r: r[2]) == sorted(expect, key=lambda r: r[2]) and len(packs) < 400


def test_packed_rows_behind_a_decision_are_dropped():
    """A pack may begin before what its key has decided; only the rows after that count, others are not reported."""
    import pickle

    import pandas as pd
    fold = stateful._PackedFold(["t", "event_id"], [True, True], ["k", "t", "event_id", "n"], lambda: {"n": 0},
                                lambda state, t, event_id: (state.update(n=state["n"] + 1) or state["n"],), 300, 60,
                                lambda made: made[0] % 2 == 1)
    kept = Kept()
    fold.init(kept)

    def send(*times):
        body = pickle.dumps([(t, t) for t in times])
        list(fold.handleInputRows(("a",), iter([pd.DataFrame({"ts": [pd.Timestamp(times[-1], unit="s")], "body": [body]})]), None))

    def pass_by(second):
        made = fold.handleExpiredTimer(("a",), Mark(second * 1000), Mark(second * 1000))
        return [row for frame in made for row in frame[["t", "n"]].values.tolist()]

    send(10, 20, 130)
    assert pass_by(125) == [[10, 1]]                            # up to 120 is decided
    send(119, 120, 140)
    assert pass_by(240) == [[120, 3], [140, 5]]
    assert pass_by(10_000) == [] and not kept.values            # long quiet: forgotten


def test_streams_hand_on_recorded_rows_only(spark, tmp_path):
    """Skipped duplicates, unfinished patterns and cooled-down alerts do not leave the task."""
    seen = []
    fold_stream = stateful._fold_stream

    def note(df, keys, inputs, start, step, outputs, memory, keep=None):
        seen.append([keep(made) for made in ((None, False), (3, True), (False,), (True,))] if keep else None)
        return fold_stream(df, keys, inputs, start, step, outputs, memory, keep)

    ev = make(spark, 10, 3, 400, ["m1"], ["error"]).withColumnsRenamed({"a": "message", "b": "severity"})
    ev = ev.withColumns({"type": F.lit("x"), "rule_name": F.lit("r")})
    write_parts(spark, f"{tmp_path}/k", ev, parts=1)
    source = stream(spark, f"{tmp_path}/k", ev)
    stateful._fold_stream = note
    try:
        stateful.alerts_stream(source)
        stateful.match_pattern_stream(source, ["x"], 10, "message")
        stateful.cooldown_stream(source)
    finally:
        stateful._fold_stream = fold_stream
    assert seen[0][:2] == seen[1][:2] == [False, True] and seen[2][2:] == [False, True]


def test_expiring_writes(spark, tmp_path):
    """Two keys, replaced and endless writes, rows late and in any order, against the steps row by row."""
    rnd = random.Random(11)
    data = [(k, t, rnd.choice(["x", "y", None]), k % 7, rnd.choice([None, 0, 5, 40, 300, 900]))
            for k, t in enumerate(sorted(rnd.randint(0, 6000) for _ in range(500)))]
    writes = spark.createDataFrame(data, "event_id bigint, t bigint, a string, b int, ttl int")
    expect = set()
    for n, (_, t, a, b, ttl) in enumerate(data):
        later = [r[1] for r in data[n + 1:] if r[2:4] == (a, b)]
        if ttl is not None and (not later or later[0] > t + ttl):
            expect.add((a, b, t + ttl))
    write_parts(spark, f"{tmp_path}/e", writes.select("event_id", "t", "a", "b", "ttl"), parts=5, late=LATE)
    out = flows.run_available(stateful.expire_stream(stream(spark, f"{tmp_path}/e", writes), ["a", "b"]))
    got = [(r["a"], r["b"], r["expires_at"] - BASE) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expect))
    shards = stateful.expire_stream(stream(spark, f"{tmp_path}/e", writes), ["event_id"])
    assert flows.run_available(shards).count() == sum(1 for r in data if r[4] is not None)
