"""Batch decisions against plain sequential runs, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tradebook.operators import keyed, limits, nodes
from tradebook.plans import scale

RULES = {"default": (3, 10, 25), "tight": (1, 5, 0)}


def skewed(n, seed, span):
    rnd = random.Random(seed)
    return [(k, rnd.randint(0, span), "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", rnd.random()) for k in range(n)]


@pytest.mark.parametrize("span", [60, 900, 20000])
@pytest.mark.parametrize("chunk", [7, 3600])
def test_rate_limit(spark, span, chunk):
    rows = [(k, t, d, "tight" if x < 0.3 else "other") for k, t, d, x in skewed(1200, span, span)]
    state, expected = {}, {}
    for k, t, d, r in sorted(rows, key=lambda x: (x[1], x[0])):
        n, period, penalty = RULES.get(r, RULES["default"])
        s = state.setdefault((r, d), {"stamps": [], "until": None})
        if s["until"] is not None and t < s["until"]:
            expected[k] = "blocked"
            continue
        s["stamps"] = [x for x in s["stamps"] if x > t - period]
        if len(s["stamps"]) >= n:
            s["until"], expected[k] = t + penalty, "limited"
        else:
            s["stamps"].append(t)
            expected[k] = "admitted"
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, domain string, rule string")
    got = {r["event_id"]: r["decision"] for r in limits.limit_rate(df, RULES, chunk).collect()}
    assert got == expected


@pytest.mark.parametrize("span", [300, 9000, 10**6])
def test_lockouts(spark, span):
    rows = [(k, t, u, x < 0.25) for k, t, u, x in skewed(1500, span, span)]
    state, expected = {}, {}
    for k, t, u, ok in sorted(rows, key=lambda x: (x[1], x[0])):
        s = state.setdefault(u, {"f": [], "lock": None})
        if s["lock"] is not None and t - s["lock"] <= 300:
            expected[k] = "ignored"
            continue
        s["lock"] = None
        if ok:
            s["f"], expected[k] = [], "success"
        else:
            s["f"] = [f for f in s["f"] if t - f < 1800] + [t]
            expected[k] = "failure"
            if len(s["f"]) >= 5:
                s["lock"], expected[k] = t, "lockout"
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, username string, success boolean")
    assert {r["event_id"]: r["outcome"] for r in limits.lockouts(df, chunk_seconds=50).collect()} == expected


def test_five_failures_lock(spark):
    df = spark.createDataFrame([(k, k, "test_user", k == 5) for k in range(6)], "event_id bigint, t bigint, username string, success boolean")
    assert [r["outcome"] for r in limits.lockouts(df).orderBy("t").collect()] == ["failure"] * 4 + ["lockout", "ignored"]


@pytest.mark.parametrize("threshold", [1, 5])
def test_alerts(spark, threshold):
    rows = [(k, t, m, ["error", "warning", "info"][int(x * 3)]) for k, t, m, x in skewed(1500, 3, 4000)]
    count, last, expected = {}, {}, {}
    for k, t, m, s in sorted(rows, key=lambda x: (x[1], x[0])):
        if (s, m) in last and t - last[s, m] < 300:
            continue
        count[m] = count.get(m, 0) + 1
        loud = count[m] >= threshold
        if loud:
            last[s, m] = t
        expected[k] = (count[m], loud)
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, message string, severity string")
    got = limits.alerts_with_dedup(df, threshold, 300, chunk_seconds=100)
    assert {r["event_id"]: (r["count"], r["notified"]) for r in got.collect()} == expected


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("reuse", [True, False])
@pytest.mark.parametrize("within", [5, 60])
@pytest.mark.parametrize("chunk", [7, 100])
def test_patterns(spark, ordered, reuse, within, chunk):
    types = ["A", "B", "A"] if ordered else ["A", "B", "C"]
    rows = [(k, t, n, "ABCD"[int(x * 4)]) for k, t, n, x in skewed(1500, within, 3000)]
    window, expected = {}, set()
    for k, t, n, kind in sorted(rows, key=lambda x: (x[1], x[0])):
        w = window.get(n, [])
        if w and t - w[0][0] > within:
            w = []
        fits = kind in types and (not ordered or (len(w) < len(types) and types[len(w)] == kind))
        if fits:
            w = w + [(t, k, kind)]
            if len(w) == len(types) and (ordered or {x[2] for x in w} == set(types)):
                expected.add((n, w[0][0], t, tuple(x[1] for x in w)))
                again = reuse and (not ordered or types[0] == kind)
                w = [(t, k, kind)] if again else []
        window[n] = w
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, node_id string, type string")
    got = limits.match_pattern(df, types, within, "node_id", ordered, None, reuse, chunk_seconds=chunk)
    assert {(r["node_id"], r["start_t"], r["end_t"], tuple(r["event_ids"])) for r in got.collect()} == expected


@pytest.mark.parametrize("chunk", [13, 10**6])
def test_streaks_and_uptime(spark, chunk):
    rows = [(k, t, n, "error" if x < 0.6 else "healthy") for k, t, n, x in skewed(1500, 11, 5000)]
    streak, up, expected = {}, {}, {}
    for k, t, n, s in sorted(rows, key=lambda x: (x[1], x[0])):
        before = streak.get(n, 0)
        streak[n] = before + 1 if s == "error" else 0
        u = up.setdefault(n, [0, 0, None])
        if u[2] is not None:
            u[0 if s == "healthy" else 1] += t - u[2]
        u[2] = t
        expected[k] = (streak[n], s != "error" and before > 0, before if s != "error" and before else None, u[0], u[1])
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, node_id string, status string")
    both = nodes.consecutive_errors(df, 3, chunk).join(nodes.node_uptime(df, chunk).select("event_id", "uptime", "downtime"), "event_id")
    assert {r["event_id"]: (r["streak"], r["recovered"], r["previous_errors"], r["uptime"], r["downtime"]) for r in both.collect()} == expected


def test_lookup_on_a_hot_key(spark):
    rows = [(k, t, d, ["SET", "GET", "DELETE", "GET"][int(x * 4)], None if k % 3 else 20) for k, t, d, x in skewed(1500, 5, 3000)]
    alive, expected = {}, {}
    for k, t, d, kind, ttl in sorted(rows, key=lambda x: (x[1], x[0])):
        if kind == "GET":
            expected[k] = alive.get(d, -1) >= t
        else:
            alive[d] = t + (ttl or 3600) if kind == "SET" else -1
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, cache_key string, type string, ttl bigint")
    for chunk in (17, 10**6):
        got = keyed.cache_lookup(df, chunk_seconds=chunk)
        assert {r["event_id"]: r["hit"] for r in got.collect()} == expected
    again = keyed.cache_lookup(df.repartition(5, F.rand(3)), chunk_seconds=17)
    assert {r["event_id"]: r["hit"] for r in again.collect()} == expected


def test_dense_hours_are_cut_by_rows(spark):
    """Nearly all rows in one key and hour: pieces are bounded, results are those of one chunk."""
    rnd = random.Random(21)
    rows = [(k, rnd.randrange(3000), "hot" if rnd.random() < 0.95 else "cold", rnd.choice(["error", "healthy"]),
             rnd.choice(["SET", "GET", "GET", "DELETE"]), rnd.choice([None, 5, 100])) for k in range(2000)]
    rows += [(2000 + k, 100_000 + 7 * k, "hot", "healthy", "GET", None) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id bigint, t bigint, node_id string, status string, type string, ttl int") \
        .withColumn("cache_key", F.col("node_id"))
    cut = scale.with_row_chunks(df, ["node_id"], ["t", "event_id"], 3600, 100)
    sizes = [r["count"] for r in cut.groupBy("node_id", scale.CHUNK).count().collect()]
    assert sum(sizes) == 2020 and max(sizes) < 300 and len(sizes) > 12
    spans = cut.groupBy("node_id", scale.CHUNK).agg(F.min(F.struct("t", "event_id")).alias("a"), F.max(F.struct("t", "event_id")).alias("z")).collect()
    for node in ("hot", "cold"):
        ends = [(tuple(r["a"]), tuple(r["z"])) for r in sorted(spans, key=lambda r: r[scale.CHUNK]) if r["node_id"] == node]
        assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))

    def same(run):
        got, expect = ([sorted(map(str, run(**how).collect())) for how in ({"most_rows": 100}, {})])
        assert got == expect and got

    same(lambda **how: nodes.node_uptime(df, **how))
    same(lambda **how: nodes.consecutive_errors(df, **how))
    same(lambda **how: keyed.cache_lookup(df, **how))
    for ordered, reuse in ((True, False), (False, True)):
        same(lambda **how: limits.match_pattern(df, ["SET", "GET", "DELETE"], 4, None, ordered, None, reuse, **how))
