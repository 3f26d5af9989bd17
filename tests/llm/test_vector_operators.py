"""Clustering and negative mining against plain Python on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradebook.llm import hard_negatives as H
from tradebook.llm import sharded_lloyd as S

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_lloyd(vectors, starts, rounds):
    """Centroids and assignment by the book; vectors and starts are lists of integer lists."""
    def nearest(v, centroids):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    centroids = [list(c) for c in starts]
    for _ in range(rounds):
        got = [nearest(v, centroids)[1] for v in vectors]
        for k in range(len(centroids)):
            mine = [v for v, g in zip(vectors, got, strict=True) if g == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return centroids, [nearest(v, centroids) for v in vectors]


@pytest.mark.parametrize("block,chunk", [(32, 4096), (3, 7), (8, 1)])
def test_lloyd_against_plain_python(spark, block, chunk):
    rng = random.Random(3)
    dims, k = 8, 5
    rows = [(i, [rng.randrange(-40, 40) for _ in range(dims)]) for i in range(60)]
    rows += [(i + 100, rows[0][1]) for i in range(30)] + [(7, rows[7][1]), (None, rows[9][1])]
    df = spark.createDataFrame(rows, "id bigint, v array<bigint>")
    got, centroids = S.lloyd(df, F.coalesce(F.col("id"), F.lit(-1)), dims, k, 3, block, chunk)
    start = [v for _, v in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))[:k]]
    expect, placed = plain_lloyd([v for _, v in rows], start, 3)
    assert centroids.tolist() == expect
    key = [(-1 if i is None else i, c, d) for (i, _), (d, c) in zip(rows, placed, strict=True)]
    assert sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted(key)


def test_lloyd_takes_whole_vectors_only(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [1.0, 2.0], 0), (2, [1.0], 0), (3, None, 0), (4, [1.0, None], 0), (5, [inf, 1.0], 0), (6, [nan, 1.0], 0),
            (7, [-0.01, 1e30], 1)]
    df = spark.createDataFrame(rows, VECTORS).filter(S.complete(F.col("embedding"), 2)) \
        .select("vec_id", S.whole_numbers(F.col("embedding"), 64).alias("v"))
    assert sorted(map(tuple, df.collect())) == [(1, [64, 128]), (7, [-1, S.LIMIT])]


def test_lloyd_of_few_vectors(spark):
    none = spark.createDataFrame([], "id bigint, v array<bigint>")
    got, centroids = S.lloyd(none, F.col("id"), 4)
    assert got.collect() == [] and len(centroids) == 0
    two = spark.createDataFrame([(1, [0, 0]), (2, [S.LIMIT, -S.LIMIT])], "id bigint, v array<bigint>")
    got, centroids = S.lloyd(two, F.col("id"), 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (2, 1, 0)] and len(centroids) == 2
    with pytest.raises(ValueError):
        S.pack(two, S.MOST_DIMS + 1)


def test_floors_of_negative_sums(spark):
    rows = [(1, [-1]), (2, [-2]), (3, [100])]
    _, centroids = S.lloyd(spark.createDataFrame(rows, "id bigint, v array<bigint>"), -F.col("id"), 1, 2, 1)
    assert centroids.tolist() == [[100], [-2]]          # floor(-3 / 2)


def test_op11_on_given_and_odd_rows(spark, tmp_path):
    from tradebook.llm.queries import QUERIES
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(64)], 1) for i in range(20)] + [(50, [0.5] * 63, 1), (51, None, None)]
    spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {r["vec_id"]: r for r in QUERIES["op11_sharded_lloyd"](spark, str(tmp_path)).collect()}
    assert sorted(out) == list(range(20))
    vectors = [[math.floor(64 * float(np.float32(x))) for x in v] for _, v, _ in rows[:20]]
    first = sorted(range(20), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    centroids, placed = plain_lloyd(vectors, [vectors[i] for i in first], 3)
    for i, (d, c) in enumerate(placed):
        row = out[i]
        assert (row["cluster"], row["distance"]) == (c, d)
        assert row["cluster_inertia"] == sum(x for x, y in placed if y == c) and row["inertia"] == sum(x for x, _ in placed)
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


# --- hard negatives ----------------------------------------------------------------------------------------------------
def plain_mine(rows, every, positives, negatives, low, high):
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = sorted((-int(np.dot(va, v)), i, lab) for i, lab, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [(t, n) for t, n, lab in scored if lab != la and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def clustered(rng, n, dims, spread, groups=6):
    centres = [[rng.randrange(-60, 60) for _ in range(dims)] for _ in range(groups)]
    return [(i, rng.randrange(3), [x + rng.randrange(-spread, spread + 1) for x in centres[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("spread,leaf_rows", [(5, 16), (60, 16), (60, 2048)])
def test_mining_against_plain_python(spark, spread, leaf_rows):
    rows = clustered(random.Random(spread), 400, 6, spread)
    rows += [(1000 + i, i % 3, rows[10][2]) for i in range(90)]         # copies: a leaf of many blocks, ties
    df = spark.createDataFrame(rows + rows[:5], "id bigint, label bigint, v array<bigint>")
    got = H.mine(df, 6, 20, 3, 4, leaf_rows=leaf_rows, fit_rows=300)
    assert sorted(map(tuple, got.collect())) == plain_mine(rows, 20, 3, 4, 30, 90)


def test_tree_passes_over_leaves_but_no_find():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (12, 8))
    rows = (centres[rng.integers(0, 12, 3000)] + rng.integers(-9, 10, (3000, 8))).astype(np.int64)
    norm = float((rows ** 2).sum(axis=1).max())
    tree = H.grow(rows[:600].astype(float), norm, len(rows), 100)
    lifted = tree.lift(rows)
    leaf = tree.route(lifted)
    ranges = {k: tree.ranges(k, lifted[leaf == k]) for k in np.unique(leaf)}
    tree.set_ranges({k: r[0] for k, r in ranges.items()}, {k: r[1] for k, r in ranges.items()})
    tree.blocks = np.bincount(leaf, minlength=len(tree.paths))
    q = rows[:40].astype(float)
    scores = q @ rows.T
    low, high = np.quantile(scores, 0.90, axis=1), np.quantile(scores, 0.93, axis=1)
    square = (q ** 2).sum(axis=1)
    near, far = (np.sqrt(np.maximum(norm + square - 2 * x, 0))[:, None] for x in (high, low))
    order = tree.visits(q, near, far)[:, 0]
    hits = (scores >= low[:, None]) & (scores <= high[:, None])
    for a in range(len(q)):
        assert (order[a, leaf[hits[a]]] >= 0).all()
    assert (order < 0).mean() > 0.5             # most leaves are passed over where rows lie in clusters
    # a leaf keeps its place while the far radius shrinks
    less = tree.visits(q, near, (near + far) / 2)[:, 0]
    assert ((less == order) | (less == -1)).all()


def test_mining_of_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (100, 1, [3, 4]), (200, 2, [0, 0]), (1, 2, [2, 2]), (2, 1, [-3, -4]), (3, 2, [S.LIMIT, 0])]
    df = spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>").withColumn("score", F.lit("x"))
    assert sorted(map(tuple, H.mine(df, 2).collect())) == plain_mine(rows, 100, 5, 10, 30, 90)
    assert H.mine(df.limit(0), 2).collect() == []
    assert H.mine(df.filter("id in (1, 2)"), 2).collect() == []         # no anchors
    assert H.mine(df.filter("id = 0"), 2).collect() == []               # an anchor alone


def test_products_beyond_doubles():
    a = np.array([[S.LIMIT, 1, S.LIMIT]] * 2)
    assert H._products(a, a).tolist() == [[2 * S.LIMIT ** 2 + 1] * 2] * 2


def test_rows_of_one_id(spark):
    """Exact repeats count once; different rows of one id are anchors of their own."""
    rows = [(0, 1, [10, 0]), (0, 1, [10, 0]), (0, 2, [0, 10]), (1, 1, [9, 1]), (2, 2, [4, 1]), (3, 1, [1, 4])]
    got = sorted(map(tuple, H.mine(spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>"), 2).collect()))
    assert got == sorted(plain_versions(rows)) and got


def plain_versions(rows):
    once = [rows[0], *rows[2:]]
    out = []
    for k, (a, la, va) in enumerate(once):
        if a % 100:
            continue
        scored = sorted((-int(np.dot(va, v)), i, lab) for j, (i, lab, v) in enumerate(once) if j != k)
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fits = [(t, n) for t, n, lab in scored if lab != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)]
    return out


def test_visits_are_never_broadcast(spark, monkeypatch):
    """Visits come from small files of anchors, but grow with anchors x leaves: no size of a file may send them to the driver."""
    plans = []

    def settle(df, write=H.settle):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(H, "settle", settle)
    rows = clustered(random.Random(5), 120, 4, 20)
    got = H.mine(spark.createDataFrame(rows, "id bigint, label bigint, v array<bigint>"), 4, 20, 3, 4, leaf_rows=32)
    assert sorted(map(tuple, got.collect())) == plain_mine(rows, 20, 3, 4, 30, 90)
    visits = [p for p in plans if "asks" in p]
    assert visits and not any("Broadcast" in p for p in visits)


def test_sample_of_rows_that_share_an_id(spark, monkeypatch):
    sizes = []

    def grow(sample, *more, build=H.grow):
        sizes.append(len(sample))
        return build(sample, *more)

    monkeypatch.setattr(H, "grow", grow)
    df = spark.range(2000).select(F.lit(7).cast("long").alias("id"), F.lit(1).cast("long").alias("label"),
                                  F.array("id", F.lit(1).cast("long")).alias("v"))
    tree, _ = H.index(df, 2, 64, 100)
    assert 0 < sizes[0] < 300 and tree.blocks.sum() > 1


def test_packed_arrays():
    arrays = {"a": np.arange(3, dtype="<i1"), "b": np.array([[True, False, True]]), "c": np.zeros((0, 4)),
              "d": np.asfortranarray(np.arange(6).reshape(2, 3))[:, ::2], "e": np.array([-np.inf, 1.5])}
    back = H._load(H._dump(**arrays))
    assert list(back) == list(arrays)
    for name, a in arrays.items():
        assert back[name].dtype == a.dtype and back[name].shape == a.shape and (back[name] == a).all()
