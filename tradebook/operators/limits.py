"""Sequential decisions per key: rate limits, lock-outs, alert de-duplication, event patterns.

A decision depends on earlier decisions, so these are small state machines. Batch runs first
reduce rows of one key and time unit to one summary row, cut keys at idle gaps longer than the
machine's memory, and fold the summaries; patterns are matched per time chunk. Streams run the
same steps row by row (tradebook.streaming.stateful).
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.operators.keyed import with_rule
from tradebook.plans.scale import CHUNK, first_rows, sorted_fold, sorted_groups, spaced, with_row_chunks, with_sessions

# --- steps ----------------------------------------------------------------------------------


def limit_start() -> dict:
    return {"stamps": [], "blocked": None}


def limit_step(state: dict, t, n: int, limit: int, period, penalty) -> tuple[int, bool]:
    """(admitted, violated) for ``n`` requests at ``t``.

    Only admitted requests count against the limit; the first refusal blocks for the penalty.
    """
    if state["blocked"] is not None and t < state["blocked"]:
        return 0, False
    stamps = [s for s in state["stamps"] if s[0] > t - period]
    room = limit - sum(s[1] for s in stamps)
    admitted = min(n, max(room, 0))
    if admitted:
        stamps.append([t, admitted])
    state["stamps"] = stamps
    if admitted < n:
        state["blocked"] = t + penalty
    return admitted, admitted < n


def lockout_start() -> dict:
    return {"failures": [], "locked": None}


def lockout_step(state: dict, t, rows: int, lead: int, success: bool, later_lock: int, tail: int,
                 max_failed: int, window, duration) -> tuple[int, int]:
    """(acted, lock position) for the attempts of one user at ``t``.

    ``lead`` failures come before the first success, ``later_lock`` is the position at which a run
    of failures after a success reaches the limit (0: none), ``tail`` failures follow the last
    success. Attempts after position ``acted`` are ignored because the user is locked.
    """
    if state["locked"] is not None:
        if t - state["locked"] <= duration:
            return 0, 0
        state["locked"] = None
    failures = [f for f in state["failures"] if t - f < window]
    at = max(1, max_failed - len(failures))
    if lead >= at:
        state["failures"], state["locked"] = failures + [t] * at, t
        return at, at
    failures += [t] * lead
    if success:
        if later_lock:
            state["failures"], state["locked"] = [t] * max_failed, t
            return later_lock, later_lock
        failures = [t] * tail
    state["failures"] = failures
    return rows, 0


def alert_start() -> dict:
    return {"count": 0, "stamps": [], "notified": {}}


def alert_step(state: dict, t, severity: str, threshold: int, window, expiry=None) -> tuple[int | None, bool]:
    """(count, notified) of a recorded alert, (None, False) for a skipped duplicate.

    With ``expiry``, alerts and notifications of ``expiry`` seconds ago or more are forgotten first.
    """
    if expiry is not None:
        state["stamps"] = [s for s in state["stamps"] if s > t - expiry]
        state["notified"] = {k: s for k, s in state["notified"].items() if s > t - expiry}
        state["count"] = len(state["stamps"])
    last = state["notified"].get(severity)
    if last is not None and t - last < window:
        return None, False
    state["count"] += 1
    if expiry is not None:
        state["stamps"].append(t)
    notify = state["count"] >= threshold
    if notify:
        state["notified"][severity] = t
    return state["count"], notify


def pattern_start() -> dict:
    return {"start": None, "hits": [], "types": []}


def pattern_step(state: dict, t, event_id: int, kind: str, types: Sequence[str], within, ordered: bool,
                 reuse: bool) -> tuple:
    """(start, event ids) when the event completes a match, else (None, None).

    One window is open at a time; it begins at its first matched event and is dropped once an
    event arrives more than ``within`` later.
    """
    if state["hits"] and t - state["start"] > within:
        state.update(pattern_start())

    def take() -> bool:
        have = len(state["hits"])
        # a full window that is no match is stuck until it expires
        if have >= len(types) or (ordered and types[have] != kind):
            return False
        if not state["hits"]:
            state["start"] = t
        state["hits"].append(event_id)
        state["types"].append(kind)
        return len(state["hits"]) == len(types) and (ordered or set(state["types"]) == set(types))

    if kind not in types or not take():
        return None, None
    out = state["start"], list(state["hits"])
    state.update(pattern_start())
    if reuse and len(types) > 1:
        take()
    return out


# --- batch operators ------------------------------------------------------------------------

def _decide(ruled: DataFrame, keys: Sequence[str], chunk_seconds: int) -> DataFrame:
    """Decision per request of rows with max_requests, period and penalty."""
    ticks = ruled.groupBy(*keys, "t").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("max_requests", "period", "penalty")])
    runs = with_sessions(ticks, keys, "t", F.greatest("period", "penalty"), chunk_seconds)
    folded = sorted_fold(runs, [*keys, "_session"], ["t"], ["t", "n", "max_requests", "period", "penalty"],
                         limit_start, limit_step, "admitted bigint, violated boolean")
    w = Window.partitionBy(*keys, "t").orderBy("event_id")
    placed = ruled.select(*keys, "t", "event_id", F.row_number().over(w).alias("_pos"))
    joined = placed.join(folded.select(*keys, "t", "admitted", "violated", "penalty"), [*keys, "t"])
    over = F.col("_pos") - F.col("admitted")
    decision = F.when(over <= 0, "admitted") \
        .when(F.col("violated") & ((over == 1) | (F.col("penalty") == 0)), "limited").otherwise("blocked")
    return joined.select("event_id", "t", *keys, decision.alias("decision"))


def limit_rate(requests: DataFrame, rules: dict[str, tuple[int, int, int]] | None = None,
               chunk_seconds: int = 3600) -> DataFrame:
    """Decision per request (event_id, t, rule, domain): admitted, limited (starts a block) or
    blocked."""
    return _decide(with_rule(requests, rules), ["rule", "domain"], chunk_seconds)


def limit_sliding(requests: DataFrame, key: str, n: int = 10, window: int = 60,
                  chunk_seconds: int = 3600) -> DataFrame:
    """Sliding window without penalty: a request is refused while ``n`` admitted ones are younger
    than ``window``."""
    ruled = requests.withColumns({"max_requests": F.lit(n), "period": F.lit(window), "penalty": F.lit(0)})
    return _decide(ruled, [key], chunk_seconds).withColumn("allowed", F.col("decision") == "admitted").drop("decision")


def lockouts(attempts: DataFrame, max_failed: int = 5, window: int = 1800, duration: int = 300,
             chunk_seconds: int = 3600) -> DataFrame:
    """Outcome per login attempt (event_id, t, username, success): success, failure, lockout (the
    failure that locks) or ignored (while locked)."""
    key = ["username"]
    w = Window.partitionBy("username", "t").orderBy("event_id")
    bad = ~F.col("success")
    seq = attempts.withColumn("_pos", F.row_number().over(w)) \
        .withColumn("_run", F.count_if("success").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("username", "t", "_run").orderBy("event_id")
    seq = seq.withColumn("_fail", F.when(bad, F.count_if(bad).over(in_run.rowsBetween(Window.unboundedPreceding, 0))))
    ticks = seq.groupBy("username", "t").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad & (F.col("_run") == 0)).alias("lead"),
        (F.max("_run") > 0).alias("has_success"),
        F.coalesce(F.min(F.when((F.col("_run") > 0) & (F.col("_fail") == max_failed), F.col("_pos"))), F.lit(0))
        .alias("later_lock"),
        F.max(F.struct("_run", F.coalesce("_fail", F.lit(0)).alias("f")))["f"].alias("tail"))
    runs = with_sessions(ticks, key, "t", max(window, duration + 1), chunk_seconds)

    def step(state, t, rows, lead, has_success, later_lock, tail):
        return lockout_step(state, t, rows, lead, has_success, later_lock, tail, max_failed, window, duration)

    folded = sorted_fold(runs, [*key, "_session"], ["t"],
                         ["t", "rows", "lead", "has_success", "later_lock", "tail"],
                         lockout_start, step, "acted bigint, lock_pos bigint")
    joined = seq.select("event_id", "t", "username", "success", "_pos").join(
        folded.select("username", "t", "acted", "lock_pos"), ["username", "t"])
    outcome = F.when(F.col("_pos") > F.col("acted"), "ignored").when(F.col("_pos") == F.col("lock_pos"), "lockout") \
        .when(F.col("success"), "success").otherwise("failure")
    return joined.select("event_id", "t", "username", "success", outcome.alias("outcome"))


def failed_attempts(decided: DataFrame, as_of: int, window: int = 1800, duration: int = 300) -> DataFrame:
    """Per user the failures still held against them and whether they are locked at ``as_of``.

    ``decided`` is the result of lockouts; failures count since the last success and within
    ``window`` of the user's last failure.
    """
    at = F.struct("t", "event_id")
    failed = F.col("outcome").isin("failure", "lockout")
    per = decided.groupBy("username").agg(
        F.max(F.when(F.col("outcome") == "success", at)).alias("_ok"), F.max(F.when(failed, F.col("t"))).alias("_last"),
        F.max(F.when(F.col("outcome") == "lockout", at)).alias("_lock"))
    held = decided.filter(failed).join(per, "username").filter(
        (F.col("_ok").isNull() | (at > F.col("_ok"))) & (F.col("_last") - F.col("t") < window)) \
        .groupBy("username").agg(F.count(F.lit(1)).alias("n"))
    locked = F.col("_lock").isNotNull() & (F.col("_ok").isNull() | (F.col("_lock") > F.col("_ok"))) \
        & (F.lit(as_of) - F.col("_lock.t") <= duration)
    return per.join(held, "username", "left").select(
        "username", F.coalesce("n", F.lit(0)).alias("failed_attempts"), locked.alias("locked"))


def alerts_with_dedup(events: DataFrame, threshold: int = 5, window: int = 300, chunk_seconds: int = 3600,
                      expiry: int | None = None) -> DataFrame:
    """Recorded alerts (event_id, t, message, severity) with their running count and notifications.

    With ``expiry`` (seconds) alerts and notifications that old no longer count: a message's count is that of
    its alerts recorded less than ``expiry`` seconds ago. Without it counts never fall.

    The first ``threshold - 1`` alerts of a message are recorded silently; from then on every
    recorded alert is a notification and keeps its (severity, message) quiet for ``window``
    seconds. That makes the rest a greedy spacing per (message, severity), so a message that holds
    most rows is reduced to its distinct times before anything is shuffled.
    """
    rows = events.select("event_id", "t", "message", "severity")
    if expiry is not None:
        return _expiring_alerts(rows, threshold, window, expiry, chunk_seconds)
    at = F.struct("t", "event_id")
    order = Window.partitionBy("message").orderBy("t", "event_id")
    silent = threshold - 1
    if silent:
        early = rows.withColumn("count", F.row_number().over(order)).filter(F.col("count") <= silent)
        bound = early.groupBy("message").agg(F.max(at).alias("_bound"), F.count(F.lit(1)).alias("_n")) \
            .filter(F.col("_n") == silent).drop("_n")
        later = rows.join(bound, "message").filter(at > F.col("_bound")).drop("_bound")
    else:
        early, later = None, rows
    kept = spaced(later, ["message", "severity"], "t", "event_id", window, chunk_seconds)
    loud = kept.withColumn("count", F.row_number().over(order) + silent).select(
        "event_id", "t", "message", "severity", F.col("count").cast("bigint").alias("count"),
        F.lit(True).alias("notified"))
    if early is None:
        return loud
    return early.select("event_id", "t", "message", "severity", F.col("count").cast("bigint").alias("count"),
                        F.lit(False).alias("notified")).unionByName(loud)


def _expiring_alerts(rows: DataFrame, threshold: int, window: int, expiry: int, chunk_seconds: int) -> DataFrame:
    """Alerts folded along each message, cut where a message was quiet for ``expiry`` seconds.

    Of one (message, severity, second) only the first ``threshold`` rows can be recorded: one of them is a
    notification or a duplicate of one, and all after it are duplicates.
    """
    keys = ["message", "severity", "t"]
    few = first_rows(rows, keys, ["event_id"], max(threshold, 1)) if window > 0 else rows
    runs = with_sessions(few, ["message"], "t", expiry, chunk_seconds)

    def step(state: dict, t, event_id, severity) -> tuple:
        return alert_step(state, t, severity, threshold, window, expiry)

    folded = sorted_fold(runs, ["message", "_session"], ["t", "event_id"], ["t", "event_id", "severity"],
                         alert_start, step, "count bigint, notified boolean")
    return folded.filter(F.col("count").isNotNull()).select("event_id", "t", "message", "severity", "count", "notified")


class _PatternChunk:
    """What a stretch of one key's fitting events does to any pattern window it is entered with.

    A window entering a chunk either completes, or expires at the first event more than ``within``
    after its start and leaves the matching idle from there on, or stays open. The summary keeps
    the outcome of being idle before each early event (as runs of equal outcomes) and how a window
    with 1, 2, ... matched events would go on. Entering windows can then be followed from chunk to
    chunk without the events.
    """

    def __init__(self, t: list, ids: list, kinds: list, types: Sequence[str], within, ordered: bool, reuse: bool):
        self.t, self.ids, self.kinds = t, ids, kinds
        self.types, self.within, self.ordered, self.reuse = list(types), within, ordered, reuse and len(types) > 1
        self.spots: dict[str, list[int]] = {}
        for at, kind in enumerate(kinds):
            self.spots.setdefault(kind, []).append(at)
        self.known: dict[int, dict] = {}

    def _next(self, kind: str, at: int) -> int | None:
        spots = self.spots.get(kind, [])
        k = bisect_left(spots, at)
        return spots[k] if k < len(spots) else None

    def fill(self, at: int, have: int) -> list[int]:
        """Events from ``at`` on that a window with ``have`` matched events takes."""
        if not self.ordered:
            return list(range(at, min(len(self.t), at + len(self.types) - have)))
        out = []
        for kind in self.types[have:]:
            at = self._next(kind, at)
            if at is None:
                break
            out.append(at)
            at += 1
        return out

    def after(self, done: int) -> dict:
        return self.idle_from(done if self.reuse else done + 1)

    def idle_from(self, at: int) -> dict:
        """State at the end of the chunk when no window is open before event ``at``."""
        path = []
        while True:
            if at in self.known:
                out = self.known[at]
                break
            path.append(at)
            first = (self._next(self.types[0], at) if self.ordered else at if at < len(self.t) else None)
            if first is None:
                out = pattern_start()
                break
            limit = self.t[first] + self.within
            taken = [k for k in [first, *self.fill(first + 1, 1)] if self.t[k] <= limit]
            if _full([self.kinds[k] for k in taken], self.types, self.ordered):
                at = taken[-1] if self.reuse else taken[-1] + 1
                continue
            expiry = bisect_right(self.t, limit)
            if expiry < len(self.t):
                at = expiry
                continue
            out = {"start": self.t[first], "hits": [self.ids[k] for k in taken], "types": [self.kinds[k] for k in taken]}
            break
        for k in path:
            self.known[k] = out
        return out

    def summary(self, base) -> str:
        """``base`` is the chunk's first time: windows entering it began then or before."""
        runs: list[list] = []
        for at in range(len(self.t)):
            if at and self.t[at - 1] > base + self.within:
                break
            out = self.idle_from(at)
            if runs and runs[-1][1] == out:
                runs[-1][0] = self.t[at]
            else:
                runs.append([self.t[at], out])
        going = []
        for have in range(1, len(self.types) + 1):
            rows = self.fill(0, have)
            full = rows and len(rows) == len(self.types) - have
            going.append({"rows": [[self.t[k], self.ids[k], self.kinds[k]] for k in rows],
                          "after": self.after(rows[-1]) if full else None})
        return json.dumps({"idle": self.idle_from(0), "runs": runs, "going": going})


def _full(kinds: list[str], types: Sequence[str], ordered: bool) -> bool:
    return len(kinds) == len(types) and (ordered or set(kinds) == set(types))


def _enter(state: dict, summary: dict, types: Sequence[str], within, ordered: bool) -> dict:
    """State after a chunk that is entered with ``state``."""
    if not state["hits"]:
        return summary["idle"]
    limit, going = state["start"] + within, summary["going"][len(state["hits"]) - 1]
    taken = [r for r in going["rows"] if r[0] <= limit]
    kinds = state["types"] + [r[2] for r in taken]
    if taken and going["after"] is not None and len(taken) == len(going["rows"]) and _full(kinds, types, ordered):
        return going["after"]
    for last_t, out in summary["runs"]:
        if last_t > limit:
            return out
    return {"start": state["start"], "hits": state["hits"] + [r[1] for r in taken], "types": kinds}


def match_pattern(events: DataFrame, types: Sequence[str], within: int, by: str | None = None,
                  ordered: bool = True, metadata: Column | None = None, reuse_completing_event: bool = False,
                  chunk_seconds: int = 3600, most_rows: int | None = None) -> DataFrame:
    """Non-overlapping occurrences of a composite pattern of event types.

    Events (event_id, t, type) are matched per ``by`` value (all together when None), skipping
    events that do not fit; ``metadata`` is a condition every event must meet. Matching depends on
    everything before, yet no key has to pass through one task: keys are cut into time chunks, dense ones
    by rows (``most_rows``), each chunk is summarised on its own, the small summaries are followed along the key to find
    the window every chunk is entered with, and then all chunks are matched at once.
    """
    types, reuse = list(types), reuse_completing_event
    fitting = events.filter(F.col("type").isin(types))
    if metadata is not None:
        fitting = fitting.filter(metadata)
    key = by or "_all"
    rows = with_row_chunks(fitting.select((F.col(by) if by else F.lit("all")).alias(key), "t", "event_id", "type"),
                           [key], ["t", "event_id"], chunk_seconds, most_rows)

    def summarise(_group: tuple, columns: list) -> tuple[str]:
        chunk = _PatternChunk(*columns, types, within, ordered, reuse)
        return (chunk.summary(columns[0][0]),)

    summaries = sorted_groups(rows, [key, CHUNK], ["t", "event_id"], ["t", "event_id", "type"], summarise, "summary string")

    def follow(state: dict, _chunk, summary: str) -> tuple[str]:
        entered = json.dumps(state)
        state.update(_enter(dict(state), json.loads(summary), types, within, ordered))
        return (entered,)

    entries = sorted_fold(summaries, [key], [CHUNK], [CHUNK, "summary"], pattern_start, follow, "entered string")

    def step(state: dict, t, event_id, kind, entered: str) -> tuple:
        if not state:
            state.update(json.loads(entered))
        return pattern_step(state, t, event_id, kind, types, within, ordered, reuse)

    folded = sorted_fold(rows.join(entries.select(key, CHUNK, "entered"), [key, CHUNK]), [key, CHUNK], ["t", "event_id"],
                         ["t", "event_id", "type", "entered"], dict, step, "start_t bigint, event_ids array<bigint>")
    found = folded.filter(F.col("start_t").isNotNull())
    return found.select(*([by] if by else []), "start_t", F.col("t").alias("end_t"), "event_ids")
