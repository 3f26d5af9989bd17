"""Exact Jaccard join of texts on word shingles, as a join in metric space.

Two documents link when |A n B| / |A u B| >= 0.8 over their sets of five-word shingles. The links are
not listed pair by pair: the result is the connected component of each document.

1. **Copies** have equal sets: one of them stands for all, found by a digest.
2. **Pivots and Voronoi regions.** A pivot is a set of one shingle. All pivots in A are equally near to
   A (1 - 1/|A|); the tie is broken by one fixed order of all shingles, so the regions are disjoint: A
   lies in the region of its first shingle. In the symmetric-difference metric, A is i deletions away
   from the region of its shingle of rank i.
3. **Windows by the triangle inequality.** If A and B link, then |A \\ B| <= |A| / 5 and A is that near to
   C = A n B, which lies in the region of its first shingle. So A is replicated to the regions at most
   |A| / 5 deletions away, and so is B, and both meet in the region of C. There, with ranks i and j,
   the way A - C - B is at least i + j long, while links are at most (|A| + |B|) / 9 long.
4. **Regions join recursively.** Small regions list the pairs in their windows. In a large one, each
   member is held against the region's most central document; members that link are one component and
   need not be compared with each other. Members outside it are held against the most central one of
   theirs. Now every member has a leader: a central document it links with, at an exactly known distance r, or
   itself. The leaders of a region stand for its members and form a region of their own, far smaller,
   which is joined the same way: by the triangle inequality A and B with leaders P and Q can only link if
   |P sd Q| <= r(A) + r(B) + (|A| + |B|) / 9. Leaders further apart settle all their members at once. Those
   close by, but not linked, are the last regions: their members far enough out to reach the other side are
   compared. Compared are only members of different components, the nearest pairs first: what they
   link need not be compared any further. Members travel in bounded blocks.
5. **Bounds from hash pivots.** The shingle universe is cut into parts by hash, about |A| of them. The
   numbers of a set's shingles in them form a sketch, and the sum of their differences never exceeds
   |A sd B|: a contraction, so a pair beyond (|A| + |B|) / 9 cannot link. Unrelated sets of any size
   lie far beyond. Sketches of different length are compared in the shorter one's parts. Pairs that pass
   are compared exactly.

The order of the shingles only decides about speed: shingles that many documents share come last (they are
found inside the tasks of the first scan, at most ``HOT_SHINGLES``), the rest by hash. Shingles are
64-bit hashes.

Null texts and texts without words have an empty set and link with nothing. Fewer than five words are
one shingle. Rows with a null id are linked with nothing and have a null component. Ids are whole
numbers; rows that share an id are one document, which links where any of its texts does (``n_shingles`` is
that of the row). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import BROADCAST_IDS, only_ids, query, small_batches, table, without_ids
from tradebook.session import scratch_tables, settle

WORDS = 5
#: Parts of a sketch, as powers of two: at least, at most.
LEAST_PARTS, MOST_PARTS = 6, 11
#: Parts put together for a first, quick look.
COARSE = 8
#: Shingles that are put last in the order, at most (8 bytes each are broadcast).
HOT_SHINGLES = 1 << 17
#: A shingle is called frequent inside a task from so many documents of one chunk on.
HOT_IN_CHUNK = 4
#: Regions up to this size list their pairs at once.
SMALL_REGION = 8
#: Members of a block in the second join of large regions.
BLOCK = 2048
#: Rounds of nearest pairs go on while at least this share of the tested pairs link; then all pairs are tested.
WORTH = 0.05
#: Shingles worked on at a time.
CHUNK = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_CODE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                      for b in (np.uint64(_BASE), np.uint64(inverse))]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    Bytes are lower-cased, white space between words becomes one blank; a shingle is the stretch from the
    first byte of a word to the last byte of the fourth word after it, hashed as a difference of
    prefix sums, so no word is ever an object of its own.
    """
    b = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    blank = _BLANK[b]
    if len(b) == 0 or blank.all():
        return np.zeros(0, dtype=np.uint64)
    before = np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    keep = ~(blank & before)
    b, blank = b[keep], blank[keep]
    b[blank] = 32
    if blank[-1]:
        b, blank = b[:-1], blank[:-1]
    gaps = np.flatnonzero(blank)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(b)]))
    if len(starts) >= words:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    power, inverse = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_CODE[b] * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _CODE[7]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h.sort()
    return h if len(h) < 2 else h[np.concatenate(([True], h[1:] != h[:-1]))]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets, a bounded number of shingles at a time."""
    for batch in batches:
        held, size, begin = [], 0, 0
        for k, t in enumerate(batch.column("t")):
            held.append(shingles(t.as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield batch.column("id").slice(begin, len(held)), held
                held, size, begin = [], 0, k + 1
        if held:
            yield batch.column("id").slice(begin, len(held)), held


def frequent_shingles(documents: DataFrame) -> np.ndarray:
    """Shingles that many documents share, at most ``HOT_SHINGLES``: they only steer the order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for _, held in _sets(batches):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= HOT_IN_CHUNK
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["s", "n"])

    found = _texts(documents).mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("n").desc(), "s").limit(HOT_SHINGLES).select("s").toArrow()
    return np.sort(rows.column("s").to_numpy().view(np.uint64))


def parts_of(n: np.ndarray | int) -> np.ndarray | int:
    """How many parts the sketch of a set of n shingles has: about n, a power of two."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_PARTS, MOST_PARTS)


def _sketch(h: np.ndarray) -> bytes:
    bits = int(parts_of(len(h))).bit_length() - 1
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    # capped counts differ by less, so the bound still holds
    return np.minimum(counts, 255).astype("u1").tobytes()


def _folded(sketches: list[bytes], parts: int) -> np.ndarray:
    """Sketches of ``parts`` parts or more as rows of ``parts`` sums."""
    out = np.empty((len(sketches), parts), np.int32)
    for k, sk in enumerate(sketches):
        out[k] = np.frombuffer(sk, "u1").reshape(parts, -1).sum(axis=1, dtype=np.int32)
    return out


def describe(documents: DataFrame, hot: np.ndarray) -> DataFrame:
    """(id, n, digest, sketch, window) of every document; the window has the first n // 5 + 1 shingles."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        late = shared.value
        marked = np.zeros(1 << 22, dtype=bool)
        marked[(late & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

        def window(h: np.ndarray) -> np.ndarray:
            is_late = marked[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            maybe = np.flatnonzero(is_late)
            if len(maybe):
                at = np.minimum(np.searchsorted(late, h[maybe]), len(late) - 1)
                is_late[maybe] = late[at] == h[maybe]
            order = np.concatenate((h[~is_late], h[is_late]))
            return order[:len(h) // 5 + 1].view(np.int64)

        for ids, held in _sets(batches):
            windows = [window(h) for h in held]
            offsets = np.concatenate(([0], np.cumsum([len(w) for w in windows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(h) for h in held], pa.int32()),
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in held], pa.binary()),
                pa.array([_sketch(h) for h in held], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(windows)))],
                ["id", "n", "digest", "sketch", "window"])

    bare = _texts(documents)
    kind = bare.schema["id"].dataType.simpleString()
    return bare.mapInArrow(run, f"id {kind}, n int, digest binary, sketch binary, window array<bigint>")


def _near(na: np.ndarray, nb: np.ndarray, way: np.ndarray | int) -> np.ndarray:
    """Whether sets of these sizes can link when they are ``way`` apart at least."""
    return (4 * nb <= 5 * na) & (4 * na <= 5 * nb) & (9 * way <= na + nb)


MEETINGS = "s bigint, a bigint, b bigint, n int, rank int, large boolean"


def meet(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Join the regions of a partition sorted by (s, n, id): rows (s, a, b, n, rank, large).

    Pairs (a, b) of small regions, and the members of large ones (a = b), which stream through.
    """
    carry: list[np.ndarray] | None = None
    running: int | None = None          # the large region that goes on in the next batch

    def large(s: np.ndarray, d: np.ndarray, n: np.ndarray, r: np.ndarray):
        nonlocal running
        running = int(s[0])
        return s, d, d, n, r, np.ones(len(d), bool)

    def small(s: np.ndarray, d: np.ndarray, n: np.ndarray, r: np.ndarray, group: np.ndarray):
        n, r, out = n.astype(np.int64), r.astype(np.int64), []
        for apart in range(1, SMALL_REGION):
            if len(s) <= apart:
                break
            ok = (group[apart:] == group[:-apart]) & (d[apart:] != d[:-apart]) \
                & _near(n[:-apart], n[apart:], r[:-apart] + r[apart:])
            at = np.flatnonzero(ok)
            if len(at):
                x, y = d[at], d[at + apart]
                none = np.zeros(len(at), np.int32)
                out.append((s[at], np.minimum(x, y), np.maximum(x, y), none, none, np.zeros(len(at), bool)))
        return out

    def work(cols: list[np.ndarray], last: bool):
        nonlocal carry, running
        s, d, n, r = cols
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(s)])))
        parts = []
        if running is not None and running != s[0]:
            running = None
        big = sizes > SMALL_REGION
        big[0] |= running is not None
        if not last:
            if not big[-1]:
                carry = [c[starts[-1]:] for c in cols]
                starts, sizes, big = starts[:-1], sizes[:-1], big[:-1]
        for k in np.flatnonzero(big):
            piece = slice(starts[k], starts[k] + sizes[k])
            parts.append(large(s[piece], d[piece], n[piece], r[piece]))
        many = np.flatnonzero(~big & (sizes > 1))
        if len(many):
            group = np.repeat(many, sizes[many])
            at = np.repeat(starts[many] - np.concatenate(([0], np.cumsum(sizes[many])[:-1])), sizes[many]) + np.arange(len(group))
            parts += small(s[at], d[at], n[at], r[at], group)
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[k] for p in parts])) for k in range(6)], ["s", "a", "b", "n", "rank", "large"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols, carry = [np.concatenate(x) for x in zip(carry, cols, strict=True)], None
        yield from work(cols, False)
    if carry is not None:
        yield from work(carry, True)


def _apart(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The distance |A sd B| of pairs, from their sets as binaries of sorted hashes, and whether they link."""
    for batch in batches:
        away, near = [], []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            both = np.concatenate((p, q))
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            away.append(len(both) - 2 * common)
            near.append(9 * common >= 4 * len(both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(away, pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "d", "near"])


def _set_rows(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for ids, held in _sets(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array([h.tobytes() for h in held], pa.binary())], ["id", "x"])


def _bounded(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Pairs whose sketches do not rule out that they, or members they stand for, link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        na, nb, ra, rb, la, lb, ha, hb = (batch.column(c).to_numpy().astype(np.int64)
                                          for c in ("na", "nb", "ra", "rb", "la", "lb", "ha", "hb"))
        fits = (4 * la <= 5 * hb) & (4 * lb <= 5 * ha)
        keep, parts = np.zeros(batch.num_rows, bool), parts_of(np.minimum(na, nb))
        for p in np.unique(parts[fits]).tolist():
            at = np.flatnonzero(fits & (parts == p))
            way = np.abs(_folded([x[k] for k in at], p) - _folded([y[k] for k in at], p)).sum(axis=1)
            keep[at] = 9 * (way - ra[at] - rb[at]) <= ha[at] + hb[at]
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _passing(pairs: DataFrame, described: DataFrame, leaders: DataFrame | None) -> DataFrame:
    """The pairs that sizes and sketches allow; with ``leaders`` (leader, r, lo, hi) for any members of theirs."""
    side = described.select("id", "n", "sketch")
    if leaders is None:
        side = side.withColumns({"r": F.lit(0).cast("bigint"), "lo": F.col("n"), "hi": F.col("n")})
    else:
        side = side.join(leaders.withColumnRenamed("leader", "id"), "id")

    def named(v: str, sketch: str) -> DataFrame:
        return side.select(F.col("id").alias(v), F.col("n").alias("n" + v), F.col("sketch").alias(sketch),
                           F.col("r").alias("r" + v), F.col("lo").alias("l" + v), F.col("hi").alias("h" + v))

    wide = pairs.join(named("a", "x"), "a").join(named("b", "y"), "b")
    return wide.select("a", "b", "na", "nb", "ra", "rb", "la", "lb", "ha", "hb", "x", "y").mapInArrow(_bounded, "a bigint, b bigint")


def tests(pairs: DataFrame, documents: DataFrame, described: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """(a, b, d, near) of the pairs that sketches let pass, decided on the whole sets; written.

    Documents of several texts are as near as their nearest texts.
    """
    passing = settle(_passing(pairs, described, leaders).distinct())
    ids = settle(passing.select(F.col("a").alias("id")).unionAll(passing.select("b")).distinct())
    chosen = only_ids(documents.select(F.col("doc_id"), "text"), ids, "doc_id")
    # one shuffle of the sets serves both sides
    sets = _texts(chosen).mapInArrow(_set_rows, "id bigint, x binary").distinct()
    held = passing.join(sets.select(F.col("id").alias("b"), F.col("x").alias("y")), "b") \
        .join(sets.select(F.col("id").alias("a"), "x"), "a")
    apart = held.select("a", "b", "x", "y").mapInArrow(_apart, "a bigint, b bigint, d bigint, near boolean")
    return settle(apart.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("near").alias("near")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table of pairs of ids, broadcast where its counted rows allow."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex: the smallest id it is linked with over any number of edges.

    Each round takes the smallest label among the neighbours and then the label of the label, so
    the rounds grow with the logarithm of a component's diameter. Rounds are written tables.
    """
    both = settle(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count()
    if not n:
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        seen = both.join(_small(labels.withColumnRenamed("id", "b"), n), "b").groupBy(F.col("a").alias("id")) \
            .agg(F.min("component").alias("near"))
        nearer = seen.join(_small(labels, n), "id").select("id", F.col("component").alias("old"),
                                                           F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        stepped = settle(nearer.join(_small(jump, n), "component", "left").select(
            "id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = stepped.select("id", "component")
        if stepped.filter("component < old").isEmpty():
            return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after more edges: only the components that these join are worked on. Written."""
    n = labels.count()
    if not n:
        return components(edges)
    ends = edges.select("a", "b")
    for v in ("a", "b"):
        known = labels.select(F.col("id").alias(v), F.col("component").alias("_c"))
        ends = ends.join(_small(known, n), v, "left").withColumn(v, F.coalesce("_c", v)).drop("_c")
    joined = components(ends.filter("a <> b").distinct())
    m = joined.count()
    to = joined.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    moved = labels.join(_small(to, m), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    return settle(moved.unionAll(joined.join(_small(labels.select("id"), n), "id", "left_anti").select("id", "component")))


def star(members: DataFrame, several: DataFrame | None) -> DataFrame:
    """(id, pivot) for each member of a large region and the region's pivot document.

    The pivot is the most central member, the one most of whose window lies in large regions: the same
    one in nearly all regions of a group of near copies, so the pairs are about as many as documents.
    Documents of several texts are no points of the metric space and so no pivots.
    """
    share = members.groupBy("id").agg((F.count("*") / (F.floor(F.first("n") / 5) + 1)).alias("share"))
    ranked = members.join(share, "id")
    points = ranked if several is None else without_ids(ranked, several, "id")
    pivots = points.groupBy("s").agg(F.max(F.struct("share", (-F.col("id")).alias("back"), F.col("n").alias("pn"))).alias("p")) \
        .select("s", (-F.col("p.back")).alias("pivot"), F.col("p.pn").alias("pn"))
    fits = (4 * F.col("n") <= 5 * F.col("pn")) & (4 * F.col("pn") <= 5 * F.col("n"))
    return members.join(pivots, "s").filter((F.col("id") != F.col("pivot")) & fits).select("id", "pivot").distinct()


def _ordered(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def leading(stars: DataFrame, tested: DataFrame, several: DataFrame | None) -> DataFrame:
    """(id, leader, r): of the pivots that a member links with the one with most links, and the distance."""
    held = tested.filter("near").select("a", "b", "d")
    linked = stars.withColumns({"a": F.least("id", "pivot"), "b": F.greatest("id", "pivot")}).join(held, ["a", "b"])
    if several is not None:
        linked = without_ids(linked, several, "id")
    many = linked.groupBy("pivot").agg(F.count("*").alias("links"))
    best = linked.join(many, "pivot").groupBy("id").agg(F.max(F.struct("links", (-F.col("pivot")).alias("back"), "d")).alias("m"))
    return best.select("id", (-F.col("m.back")).alias("leader"), F.col("m.d").alias("r"))


def _cross(nearest: bool):
    """Pairs of different components that distances and sketches do not rule out, block by block.

    Rows come sorted by (g, u, v): at most two blocks of members at a time. A member stands for texts of
    ``lo`` to ``hi`` shingles up to ``slack`` away from it; it is itself ``r`` away from its leader. Where a group
    has sides, only members of different sides are held against each other, whose leaders are ``apart``. With ``nearest`` each component names only the pair that leads out
    of it on the shortest way, so a round gives no more pairs than components.
    """
    def pairs(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        same = key[1] == key[2]
        rows.sort(key=lambda r: (r[1], r[0]))
        ids, n, lo, hi, slack, r, apart, side, comp, block = (np.array([row[k] for row in rows], np.int64) for k in range(10))
        parts = parts_of(n)                                     # grows with n, so later rows fold to earlier ones'
        found, level, fine, coarse, first = [], 0, None, None, 0
        for k in range(len(ids) - 1):
            if parts[k] != level:
                level, first = int(parts[k]), k
                # own sizes of this level are ``level`` at most; two leaders and two members lie (5 / 4) ** 3 apart at most
                last = len(ids) if level == 1 << MOST_PARTS else int(np.searchsorted(n, 2 * level, side="right"))
                fine = _folded([row[10] for row in rows[k:last]], level).astype(np.int16)
                coarse = fine.reshape(len(fine), -1, COARSE).sum(axis=2, dtype=np.int16)
            later = slice(k + 1, first + len(fine))
            other = np.flatnonzero((comp[later] != comp[k]) & (same | (block[later] != block[k]))
                                   & (4 * lo[later] <= 5 * hi[k]) & (4 * lo[k] <= 5 * hi[later])
                                   & ((side[later] != side[k]) | (side[k] < 0))
                                   & (9 * (np.maximum(apart[k], apart[later]) - r[later] - r[k]) <= hi[later] + hi[k])) + k + 1
            for sketch in (coarse, fine):
                if len(other):
                    way = np.abs(sketch[other - first] - sketch[k - first]).sum(axis=1, dtype=np.int64)
                    near = 9 * (way - slack[other] - slack[k]) <= hi[other] + hi[k]
                    other, way = other[near], way[near]
            if len(other):
                found.append(np.stack((np.full(len(other), k), other, way)))
        x, y, way = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        if nearest and len(x):
            owner, pair = np.concatenate((comp[x], comp[y])), np.tile(np.arange(len(x)), 2)
            order = np.lexsort((ids[y][pair], ids[x][pair], way[pair], owner))
            pair = np.unique(pair[order][np.unique(owner[order], return_index=True)[1]])
            x, y = x[pair], y[pair]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for g, u, v, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (g, u, v) != key:
                    if len(held) > 1:
                        yield pairs(key, held)
                    key, held = (g, u, v), []
                held.append(tuple(row))
        if len(held) > 1:
            yield pairs(key, held)

    return run


def _crossed(rows: DataFrame, nearest: bool) -> DataFrame:
    """Pairs out of the groups ``g`` of ``rows``, each of ``m`` members, dealt into bounded blocks."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("g", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"),
                "id", "n", "lo", "hi", "slack", "r", "apart", "side", "component", "block", "sketch")
    return dealt.repartition("g", "u", "v").sortWithinPartitions("g", "u", "v") \
        .mapInArrow(_cross(nearest), "a bigint, b bigint")


def _several_components(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of groups that hold two components or more, with the group's size ``m``."""
    open_ = rows.groupBy(*keys).agg(F.count("*").alias("m"), F.min("component").alias("_lo"), F.max("component").alias("_hi")) \
        .filter("_lo < _hi").select(*keys, "m")
    return rows.join(open_, keys)


def _labelled(rows: DataFrame, labels: DataFrame, id_: str = "id") -> DataFrame:
    known = labels.select(F.col("id").alias(id_), F.col("component").alias("_c"))
    return rows.join(known, id_, "left").withColumn("component", F.coalesce("_c", id_)).drop("_c")


class _Join:
    """What is known while regions are joined: tested pairs, links and components."""

    def __init__(self, documents: DataFrame, described: DataFrame, edges: DataFrame):
        self.documents, self.described = documents, described
        self.tested, self.labels = None, components(edges)

    def test(self, pairs: DataFrame, leaders: DataFrame | None = None) -> bool:
        """Test pairs; whether enough of them link to look for the nearest ones again."""
        found = tests(pairs, self.documents, self.described, leaders)
        self.tested = found if self.tested is None else self.tested.unionAll(found)
        near = found.filter("near").count()
        if near:
            self.labels = extended(self.labels, found.filter("near"))
        return near > 0 and near >= WORTH * found.count()

    def rounds(self, rows: Callable[[], DataFrame], found: Callable[[DataFrame, bool], DataFrame],
               leaders: DataFrame | None = None) -> None:
        """Test the pairs that ``found`` names among ``rows``: the nearest while many link, then all."""
        tried, nearest = None, True
        while True:
            rest = settle(rows())
            if rest.isEmpty():
                return
            more = found(rest, nearest).distinct().join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
            more = settle(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
            again = False
            if not more.isEmpty():
                tried = more if tried is None else tried.unionAll(more)
                again = self.test(more, leaders)
            if not nearest:
                return
            nearest = again


def _join_leaders(join: _Join, members: DataFrame, points: DataFrame, leaders: DataFrame) -> None:
    """Test the leaders that meet in a region and whose members may link."""
    led = members.select("s", "id").join(leaders.select("id", "leader"), "id").select("s", "leader").distinct()
    led = settle(_several_components(_labelled(led, join.labels, "leader"), ["s"]).select("s", F.col("leader").alias("id")))
    reach = settle(leaders.groupBy("leader").agg(F.max("r").alias("r"), F.min("n").alias("lo"), F.max("n").alias("hi")))
    wide = reach.select(F.col("leader").alias("id"), F.col("r").alias("slack"), "lo", "hi").join(points, "id")

    def rows() -> DataFrame:
        return _several_components(_labelled(led, join.labels), ["s"])

    def found(rest: DataFrame, nearest: bool) -> DataFrame:
        if nearest:
            # near copies share many regions: at first each leader looks around in its largest one only
            most = rest.groupBy("id").agg(F.max(F.struct("m", "s"))["s"].alias("s"))
            rest = _several_components(rest.select("s", "id", "component").join(most, ["id", "s"]), ["s"])
        few = rest.filter(F.col("m") <= SMALL_REGION)
        x, y = (few.select("s", F.col("id").alias(v), F.col("component").alias("c" + v)) for v in ("a", "b"))
        pairs = x.join(y, "s").filter("a < b and ca <> cb").select("a", "b")        # at most SMALL_REGION rows a key
        many = rest.filter(F.col("m") > SMALL_REGION).join(wide, "id").select(
            F.col("s").alias("g"), "*", F.lit(0).alias("r"), F.lit(0).alias("apart"), F.lit(-1).alias("side"))
        return pairs.unionAll(_crossed(many, nearest))

    join.rounds(rows, found, reach)


def _join_followers(join: _Join, points: DataFrame, leaders: DataFrame) -> None:
    """Test members of leaders that do not link but lie near enough for members to.

    Of two such leaders the one with more members is the hub. Its members come once, and those of all leaders near
    it are held against them.
    """
    reach = leaders.groupBy("leader").agg(F.count("*").alias("c"), F.max("r").alias("r"), F.max("n").alias("h"))
    x, y = (reach.select(F.col("leader").alias(v), *[F.col(c).alias(c + v) for c in ("c", "r", "h")]) for v in ("a", "b"))
    close = join.tested.filter("not near").groupBy("a", "b").agg(F.min("d").alias("d")).join(x, "a").join(y, "b") \
        .filter("ra + rb > 0 and 9 * (d - ra - rb) <= ha + hb")
    close = _labelled(_labelled(close, join.labels, "a").withColumnRenamed("component", "_first"), join.labels, "b") \
        .filter("_first <> component")

    def one(first: str, second: str) -> list:
        return [F.when(F.col("ca") >= F.col("cb"), F.col(p + first)).otherwise(F.col(p + second)) for p in ("", "r", "h")]

    (hub, hub_r, hub_h), (other, other_r, other_h) = one("a", "b"), one("b", "a")
    close = settle(close.select(hub.alias("g"), other.alias("leader"), "d", hub_r.alias("hub_r"), hub_h.alias("hub_h"),
                                other_r.alias("other_r"), other_h.alias("other_h")))
    if close.isEmpty():
        return
    own = leaders.select("id", "leader", "r").join(points.select("id", "n").distinct(), "id")
    around = close.join(own, "leader").filter("9 * (d - r - hub_r) <= n + hub_h") \
        .select("g", "id", "r", F.col("d").alias("apart"), F.lit(1).alias("side"))
    most = close.groupBy(F.col("g").alias("leader")).agg(F.max(F.expr("9 * other_r + other_h - 9 * d")).alias("most"))
    inner = own.join(most, "leader").filter("n + 9 * r + most >= 0") \
        .select(F.col("leader").alias("g"), "id", "r", F.lit(0).cast("bigint").alias("apart"), F.lit(0).alias("side"))
    out = settle(around.unionAll(inner).distinct())

    def rows() -> DataFrame:
        return _several_components(_labelled(out, join.labels), ["g"])

    def found(rest: DataFrame, nearest: bool) -> DataFrame:
        return _crossed(rest.join(points, "id").select("*", F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(0).alias("slack")), nearest)

    join.rounds(rows, found)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``documents``; written."""
    spark = documents.sparkSession
    with small_batches(spark), scratch_tables(spark) as keep:
        return keep(settle(_near_duplicates(documents)))


def _near_duplicates(documents: DataFrame) -> DataFrame:
    bare = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = settle(describe(bare, frequent_shingles(bare)))
    real = described.filter("id is not null and n > 0")
    worded = F.when(F.col("n") > 0, F.col("digest"))
    repeated = settle(described.filter("id is not null").groupBy("id").agg(
        F.count("*").alias("c"), (F.min(worded) < F.max(worded)).alias("differ")).filter("c > 1").select("id", "differ"))
    once = repeated.isEmpty()                       # no id comes twice
    copied = settle(real.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
                    .select("digest", "rep"))
    others = settle(real.select("id", "digest").join(copied, "digest").filter("id <> rep").select("id", "rep", "digest").distinct())
    # one text stands for all its copies: rows are told apart by their id, or by id and text where ids repeat
    reps = without_ids(real, others, "id") if once else \
        real.join(others.select("id", "digest"), ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
    several = None if once else settle(repeated.filter("differ").select("id"))
    if several is not None and several.isEmpty():
        several = None
    none = documents.sparkSession.createDataFrame([], "a bigint, b bigint")
    edges = none
    if several is not None:
        texts = real.select("id", "digest").distinct().join(several, "id").join(copied, "digest", "left") \
            .select("id", F.coalesce("rep", "id").alias("rep"))
        edges = none.unionAll(texts.join(texts.groupBy("id").agg(F.min("rep").alias("lo")), "id")
                                     .filter("lo < rep").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct())

    rows = reps.select("id", "n", F.posexplode("window").alias("rank", "s")).select("s", "id", "n", "rank")
    met = settle(rows.repartition("s").sortWithinPartitions("s", "n", "id").mapInArrow(meet, MEETINGS))
    members = met.filter("large").select("s", F.col("b").alias("id"), "n", "rank")
    points = reps.select("id", "n", "sketch")

    join = _Join(bare, points, settle(edges))
    stars = settle(star(members, several))
    pairs = settle(met.filter("not large").select("a", "b").unionAll(_ordered(stars)).distinct())
    join.test(pairs)
    rest = settle(_several_components(_labelled(members, join.labels), ["s"]))
    if not rest.isEmpty():
        outer = rest.join(rest.groupBy("s").agg(F.min("component").alias("component")), ["s", "component"], "left_anti")
        second = settle(star(outer.select("s", "id", "n"), several))
        join.test(settle(_ordered(second).join(pairs, ["a", "b"], "left_anti")))
        led = leading(stars.unionAll(second).distinct(), join.tested, several)
        leaders = settle(members.select("id", "n").distinct().join(led, "id", "left").select(
            "id", "n", F.coalesce("leader", "id").alias("leader"), F.coalesce("r", F.lit(0)).cast("bigint").alias("r")))
        _join_leaders(join, members, points, leaders)
        _join_followers(join, points, leaders)

    by_copy = others.select(F.col("id").alias("_copy"), F.col("rep"), F.col("digest").alias("_text"))
    is_copy = F.col("id") == F.col("_copy")
    out = described.join(by_copy, is_copy if once else is_copy & (F.col("digest") == F.col("_text")), "left") \
        .withColumn("rep", F.coalesce("rep", "id")) \
        .join(join.labels.withColumnRenamed("id", "rep"), "rep", "left") \
        .select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                F.coalesce("component", "rep").alias("component_id"))
    if once:
        return out
    # a row without words goes with the other rows of its id
    least = out.join(repeated.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").groupBy("doc_id") \
        .agg(F.min("component_id").alias("_least"))
    return out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("_least", "component_id").alias("component_id"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT doc_id, g FROM s JOIN r USING (g)),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, min(reach.b))::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n"""


@query("op8_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; rows without an id stay.

    Of rows that share an id one stays.
    """
    with scratch_tables(spark) as keep:
        gone = keep(settle(near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")))
        kept = without_ids(docs, gone, "doc_id")
        repeated = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1")
        return kept if repeated.isEmpty() else kept.filter("doc_id is null").unionAll(
            kept.filter("doc_id is not null").dropDuplicates(["doc_id"]))
