"""Hard-negative mining with a multiway hyperplane tree over inner products.

For an anchor, the positives are its best-scoring rows of the same label; the hard negatives of each positive
are the best rows of other labels whose score lies in a window below the positive's score. Scores are integer
inner products.

*Metric.* A row x is lifted by one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, so that all
rows have the same norm; an anchor gets 0 there. Its distance to a lifted row is then sqrt(M + |q|^2 - 2 score):
a window of scores is an annulus around the anchor, exactly.

*Tree* (geometric near-neighbour access tree). A node has up to ``FAN_OUT`` split points and deals its rows to the
nearest of them. The split points come from a sample of ``FIT_ROWS`` rows at most; every row is then dealt into
a leaf, and for every node and child the least and greatest distances of the child's rows to *all* split points of
the node are measured over all rows. A child is passed over if, for any split point, its range does not meet the
distances that the annulus allows (triangle inequality, both ways). Leaves are compared exactly, in integers.

*Size.* A leaf of many rows is dealt into blocks of about ``LEAF_ROWS`` by a hash of the id, so no leaf is one
task, however many copies a vector has. Anchors travel in blocks of ``ANCHORS`` with the blocks of the leaves they
can't pass over. They visit the leaves that fit best first: the best scores found narrow the annulus for the next,
larger wave. Rows, anchors and finds are written to the shared folder after each wave. Visits grow with anchors x
leaves, far beyond the files they are made from, so their join is always a shuffled one: by those files' size Spark
would broadcast them through the driver. Only the sample, the tree and its ranges come to the driver.

Rows with a null id, label or vector, vectors of another length than ``dims`` and vectors with a null or
non-finite component take no part. Exact repeats (id, label and vector) count once; rows of one id that differ are
rows of their own, and each gives its own anchor. Ties go to the smaller id, then to a hash of label and vector.
Components beyond ``LIMIT`` of ``sharded_lloyd`` are set to it. Without rows or anchors there is no result. Only
the columns named here are read, so other columns can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import bounded_sample, query, small_batches, table
from tradebook.llm.sharded_lloyd import _narrow, complete, whole_numbers
from tradebook.session import settle

#: Rows that choose the split points, at most (about).
FIT_ROWS = 4096
FAN_OUT = 16
#: Rows of a leaf block, about.
LEAF_ROWS = 2048
#: Anchors that travel together.
ANCHORS = 64
#: Visits handed to Spark at once, at most.
VISITS = 64
#: Fewest sample rows of a node for each child.
FIT_LEAST = 4
#: Leaves that an anchor visits in the first and second wave.
WAVES = (1, 16)


# --- tree --------------------------------------------------------------------------------------------------------------
@dataclass
class Node:
    points: np.ndarray          # split points, lifted
    at: int                     # place of its first split point among those of all nodes
    children: list              # Node or the number of a leaf
    low: np.ndarray             # children x split points: ranges over all rows
    high: np.ndarray


@dataclass
class Tree:
    norm: float                 # the squared norm of all lifted rows
    root: Node | int
    paths: list[list[tuple[Node, int]]]     # of each leaf: (node, child) from the root
    blocks: np.ndarray                      # of each leaf: its number of blocks

    @property
    def nodes(self) -> list[Node]:
        found = {n.at: n for path in self.paths for n, _ in path}
        return [found[at] for at in sorted(found)]

    def lift(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm - np.einsum("ij,ij->i", x, x), 0))])

    def route(self, lifted: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest split point at each node, the first of equals."""
        leaf = np.zeros(len(lifted), dtype=np.int32)

        def down(part: Node | int, rows: np.ndarray) -> None:
            if isinstance(part, int):
                leaf[rows] = part
                return
            nearest = _distances(lifted[rows], part.points, 2 * self.norm).argmin(axis=1)
            for c, child in enumerate(part.children):
                if (nearest == c).any():
                    down(child, rows[nearest == c])

        down(self.root, np.arange(len(lifted)))
        return leaf

    def ranges(self, leaf: int, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distances of rows of a leaf to the split points of all nodes on its path."""
        if not self.paths[leaf]:
            return np.empty(0), np.empty(0)
        d = np.column_stack([_distances(lifted, n.points, 2 * self.norm) for n, _ in self.paths[leaf]])
        return d.min(axis=0), d.max(axis=0)

    def set_ranges(self, low: dict[int, np.ndarray], high: dict[int, np.ndarray]) -> None:
        for leaf, path in enumerate(self.paths):
            at = 0
            for node, child in path:
                k = len(node.points)
                if leaf in low:
                    node.low[child] = np.minimum(node.low[child], low[leaf][at:at + k])
                    node.high[child] = np.maximum(node.high[child], high[leaf][at:at + k])
                at += k

    def visits(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Of searches (anchor x window) the order of visit of each leaf, -1 where it can be passed over.

        ``q``: anchors x dims; ``near``, ``far``: anchors x windows, the radii of the annulus. Leaves whose split
        point lies nearest to the inner radius come first.
        """
        square = np.einsum("ij,ij->i", q, q)
        slack = 1e-6 * np.sqrt(self.norm + square)[:, None]
        open_leaf = np.zeros((*near.shape, len(self.paths)), dtype=bool)
        apart = {n.at: np.sqrt(np.maximum(self.norm + square[:, None] - 2 * (q @ n.points[:, :-1].T), 0)) for n in self.nodes}

        def down(part: Node | int, open_here: np.ndarray) -> None:
            if isinstance(part, int):
                open_leaf[:, :, part] = open_here & (self.blocks[part] > 0)
                return
            dp = apart[part.at][:, None, :]
            least = np.maximum(dp - far[:, :, None], near[:, :, None] - dp) - slack[:, :, None]
            most = dp + far[:, :, None] + slack[:, :, None]
            for c, child in enumerate(part.children):
                keep = open_here & ((least <= part.high[c]) & (most >= part.low[c])).all(axis=2)
                if keep.any():
                    down(child, keep)

        down(self.root, far >= near - slack)
        off = np.zeros(open_leaf.shape)
        for leaf, path in enumerate(self.paths):
            if path:
                node, c = path[-1]
                off[:, :, leaf] = np.abs(apart[node.at][:, c:c + 1] - near)
        # all leaves are ranked, so that a leaf keeps its place while the far radius shrinks
        order = np.argsort(np.argsort(off, axis=2, kind="stable"), axis=2, kind="stable")
        return np.where(open_leaf, order, -1)


def _distances(x: np.ndarray, points: np.ndarray, twice: float) -> np.ndarray:
    """Distances between lifted rows and lifted split points: all have the same norm."""
    return np.sqrt(np.maximum(twice - 2 * (x @ points.T), 0))


def grow(sample: np.ndarray, norm: float, rows: int, leaf_rows: int = LEAF_ROWS, fan_out: int = FAN_OUT) -> Tree:
    """A tree for ``rows`` rows, its split points chosen far apart among the rows of ``sample``."""
    tree = Tree(norm, 0, [], np.empty(0))
    lifted = tree.lift(sample) if len(sample) else np.empty((0, 1))
    each = rows / max(len(sample), 1)
    placed = [0]

    def part(idx: np.ndarray, path: list[tuple[Node, int]]) -> Node | int:
        m = min(fan_out, int(np.ceil(len(idx) * each / leaf_rows)), len(idx) // FIT_LEAST)
        picked = _far_apart(lifted, idx, m, norm) if m > 1 else []
        if len(picked) < 2:
            tree.paths.append(path)
            return len(tree.paths) - 1
        k = len(picked)
        node = Node(lifted[picked], placed[0], [], np.full((k, k), np.inf), np.full((k, k), -np.inf))
        placed[0] += k
        nearest = _distances(lifted[idx], node.points, 2 * norm).argmin(axis=1)
        for c in range(k):
            node.children.append(part(idx[nearest == c], [*path, (node, c)]))
        return node

    tree.root = part(np.arange(len(sample)), [])
    tree.blocks = np.zeros(len(tree.paths), dtype=np.int64)
    return tree


def _far_apart(lifted: np.ndarray, idx: np.ndarray, m: int, norm: float) -> list[int]:
    """Up to ``m`` different rows among the first 3 m, each the farthest from those before."""
    few = idx[:3 * m]
    picked = [int(few[0])]
    apart = _distances(lifted[few], lifted[picked], 2 * norm)[:, 0]
    while len(picked) < m and apart.max() > 1e-6 * np.sqrt(norm):
        picked.append(int(few[apart.argmax()]))
        apart = np.minimum(apart, _distances(lifted[few], lifted[picked[-1:]], 2 * norm)[:, 0])
    return picked


# --- packed rows -------------------------------------------------------------------------------------------------------
def _dump(**arrays: np.ndarray) -> bytes:
    """Length of the head (8 bytes), head (name, type and shape of each array), the arrays; each padded to 8 bytes."""
    head = json.dumps([(name, a.dtype.str, a.shape) for name, a in arrays.items()]).encode()
    head += b" " * (-len(head) % 8)
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        parts += [a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(parts)


def _load(data: bytes) -> dict[str, np.ndarray]:
    """The arrays, read only: they stay in ``data``."""
    at = 8 + int.from_bytes(data[:8], "little")
    out = {}
    for name, kind, shape in json.loads(data[8:at]):
        a = np.ndarray(shape, kind, data, at)
        at += a.nbytes + -a.nbytes % 8
        out[name] = a
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def index(rows: DataFrame, dims: int, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS) -> tuple[Tree, DataFrame]:
    """The tree, and the blocks of its leaves (leaf, block, data), written. ``rows``: id, label, v."""
    spark = rows.sparkSession
    keyed = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "v") \
        .withColumn("version", F.xxhash64("label", "v"))
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, norm = keyed.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0))).collect()[0]
    # by id and version, each once: rows that share an id or repeat don't come together
    chosen = bounded_sample(keyed, F.concat_ws(":", "id", "version"), fit_rows, "split points") \
        .select("id", "version", "v").dropDuplicates(["id", "version"]).collect()
    chosen.sort(key=lambda r: (r["version"], r["id"]))
    tree = grow(np.array([r["v"] for r in chosen], dtype=np.float64).reshape(-1, dims), float(norm), n, leaf_rows)

    # the split points are bounded by the sample, whatever the number of rows
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.route(shared.value.lift(_vectors(batch.column("v"), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])

    routed = settle(keyed.mapInArrow(route, "leaf int, id long, label long, v array<long>, version long"))
    counts = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    for leaf, count in counts.items():
        tree.blocks[leaf] = -(-count // leaf_rows)
    sizes = spark.createDataFrame([(leaf, int(b)) for leaf, b in enumerate(tree.blocks)], "leaf int, blocks long")
    dealt = routed.join(F.broadcast(sizes), "leaf") \
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .repartition("leaf", "block").sortWithinPartitions("leaf", "block", "id", "version")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            leaf, block = t["leaf"][0].as_py(), t["block"][0].as_py()
            ids, version = t["id"].to_numpy(), t["version"].to_numpy()
            once = np.append(True, (ids[1:] != ids[:-1]) | (version[1:] != version[:-1]))
            v = _vectors(t["v"].combine_chunks(), dims)[once]
            low, high = shared.value.ranges(leaf, shared.value.lift(v))
            data = _dump(id=ids[once], version=version[once], label=t["label"].to_numpy()[once], v=_narrow(v))
            return pa.RecordBatch.from_arrays(
                [pa.array([leaf], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary()),
                 pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([high.tolist()], pa.list_(pa.float64()))],
                ["leaf", "block", "data", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block = batch.column("leaf").to_numpy(), batch.column("block").to_numpy()
            starts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0] != piece.column(c)[0] for c in ("leaf", "block")):
                    yield close()
                    held = []
                held.append(piece)
        if held:
            yield close()

    blocks = settle(dealt.select("leaf", "block", "id", "label", "v", "version").mapInArrow(
        pack, "leaf int, block int, data binary, low array<double>, high array<double>"))
    spans = blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high"))).groupBy("leaf", "pos") \
        .agg(F.min("col.low").alias("low"), F.max("col.high").alias("high")).collect()
    low, high = {}, {}
    for r in sorted(spans, key=lambda r: (r["leaf"], r["pos"])):
        low.setdefault(r["leaf"], []).append(r["low"])
        high.setdefault(r["leaf"], []).append(r["high"])
    tree.set_ranges({k: np.array(x) for k, x in low.items()}, {k: np.array(x) for k, x in high.items()})
    shared.unpersist()
    return tree, blocks.select("leaf", "block", "data")


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks of at most ``ANCHORS`` anchors (ablock, state): the rows whose id is divisible by ``every``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[np.ndarray]] = {}

        def close(keep: bool) -> Iterable[pa.RecordBatch]:
            nonlocal held, number
            full = {k: np.concatenate(x) for k, x in held.items()}
            n = len(full.get("id", ()))
            upto = n - n % ANCHORS if keep else n
            for at in range(0, upto, ANCHORS):
                part = {k: x[at:min(at + ANCHORS, upto)] for k, x in full.items()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([_dump(**part, **_none(0))], pa.binary())], ["ablock", "state"])
                number += 1
            held = {k: [x[upto:]] for k, x in full.items()}

        for batch in batches:
            for data in batch.column("data"):
                block = _load(data.as_py())
                mine = block["id"] % every == 0
                for k, x in block.items():
                    held.setdefault(k, []).append(x[mine].astype(np.int64))
                yield from close(True)
        yield from close(False)

    with small_batches(blocks.sparkSession, 16):
        return settle(blocks.mapInArrow(run, "ablock long, state binary"))


# --- search ------------------------------------------------------------------------------------------------------------
#: What a search has found so far: flat arrays, sorted by group, score (falling), id and version.
FOUND = ("group", "score", "fid", "fversion")


def _none(n: int) -> dict[str, np.ndarray]:
    return {k: np.zeros(n, dtype=np.int64) for k in FOUND}


def _best(found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The first ``k`` of each group."""
    order = np.lexsort((found["fversion"], found["fid"], -found["score"], found["group"]))
    found = {name: found[name][order] for name in FOUND}
    _, starts, counts = np.unique(found["group"], return_index=True, return_counts=True)
    keep = np.arange(len(order)) - np.repeat(starts, counts) < k
    return {name: found[name][keep] for name in FOUND}


@dataclass(frozen=True)
class Search:
    """Best ``k`` rows for each window of an anchor.

    Positives: one window, rows of the same label, no upper end. Negatives: a window for each positive, rows of
    other labels, from ``low`` to ``high`` hundredths of the positive's score.
    """

    k: int
    same: bool
    slots: int
    low: int = 0
    high: int = 0

    def windows(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors x slots: least and greatest score that count (whole numbers), and whether there is a window."""
        shape = (len(s["id"]), self.slots)
        low, high = np.full(shape, np.iinfo(np.int64).min), np.full(shape, np.iinfo(np.int64).max)
        there = np.ones(shape, dtype=bool)
        if not self.same:
            there[:] = False
            for g, score in zip(s["pgroup"], s["pscore"], strict=True):
                a, slot = divmod(int(g), self.slots)
                low[a, slot], high[a, slot] = -(-self.low * int(score) // 100), self.high * int(score) // 100
                there[a, slot] = True
        if len(s["group"]):
            groups, last, counts = np.unique(s["group"][::-1], return_index=True, return_counts=True)
            full = counts >= self.k
            bound = s["score"][::-1][last[full]]
            flat = low.reshape(-1)
            flat[groups[full]] = np.maximum(flat[groups[full]], bound)
        return low, high, there & (low <= high)

    def compare(self, q: dict[str, np.ndarray], block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The best rows of a leaf block for the open windows of some anchors."""
        score = _products(q["v"], block["v"])
        same = q["label"][:, None] == block["label"][None, :]
        fits = same & ~((q["id"][:, None] == block["id"]) & (q["version"][:, None] == block["version"])) if self.same else ~same
        out: dict[str, list[np.ndarray]] = {name: [] for name in FOUND}
        most = np.where(fits, score, np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
        reached = q["open"] & (q["low"] <= most[:, None]) & fits.any(axis=1)[:, None]
        for a in np.flatnonzero(reached.any(axis=1)):
            row = score[a]
            for slot in np.flatnonzero(reached[a]):
                at = np.flatnonzero(fits[a] & (row >= q["low"][a, slot]) & (row <= q["high"][a, slot]))
                if len(at) > self.k:
                    least = np.partition(row[at], len(at) - self.k)[len(at) - self.k]
                    at = at[row[at] >= least]
                    at = at[np.argsort(-row[at], kind="stable")][:self.k]   # block rows stand in order of id
                out["group"].append(np.full(len(at), q["anchor"][a] * self.slots + slot))
                out["score"].append(row[at])
                out["fid"].append(block["id"][at])
                out["fversion"].append(block["version"][at])
        return {name: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for name, x in out.items()}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as doubles where those hold every partial sum."""
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _visit(spark: SparkSession, tree: Tree, state: DataFrame, search: Search, first: int, last: float) -> DataFrame:
    """(ablock, leaf, block, asks): the anchors that go to each leaf block in one wave."""
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        t = shared.value
        held: list[tuple[int, int, int, bytes]] = []

        def close() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              ["ablock", "leaf", "block", "asks"])

        for batch in batches:
            for ablock, data in zip(batch.column("ablock").to_pylist(), batch.column("state").to_pylist(), strict=True):
                s = _load(data)
                low, high, there = search.windows(s)
                q = s["v"].astype(np.float64)
                square = np.einsum("ij,ij->i", q, q)[:, None]
                whole = (t.norm + square).astype(np.float64)
                near = np.sqrt(np.maximum(whole - 2 * np.minimum(high.astype(np.float64), whole / 2), 0))
                far = np.where(low == np.iinfo(np.int64).min, np.inf, np.sqrt(np.maximum(whole - 2 * low.astype(np.float64), 0)))
                order = np.where(there[:, :, None], t.visits(q, near, np.where(there, far, -1)), -1)
                due = (order >= first) & (order < last)
                for leaf in np.flatnonzero(due.any(axis=(0, 1))):
                    some = np.flatnonzero(due[:, :, leaf].any(axis=1))
                    asks = _dump(anchor=some, id=s["id"][some], version=s["version"][some], label=s["label"][some],
                                 v=_narrow(s["v"][some]), open=due[some, :, leaf], low=low[some], high=high[some])
                    for block in range(int(t.blocks[leaf])):
                        held.append((ablock, int(leaf), block, asks))
                        if len(held) == VISITS:
                            yield close()
                            held = []
        if held:
            yield close()

    # few and small files, but much work for each anchor
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return state.select("ablock", "state").repartition(parts, "ablock") \
        .mapInArrow(run, "ablock long, leaf int, block int, asks binary")


def _pairs(visits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Visits with their blocks, joined by a shuffle whatever Spark takes their sizes for."""
    return visits.hint("merge").join(blocks, ["leaf", "block"])


def _wave(tree: Tree, blocks: DataFrame, state: DataFrame, search: Search, first: int, last: float) -> DataFrame:
    """The state of all anchors after one wave of visits, written."""
    spark = state.sparkSession
    pairs = _pairs(_visit(spark, tree, state, search, first, last), blocks)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [search.compare(_load(a.as_py()), _load(d.as_py()))
                     for a, d in zip(batch.column("asks"), batch.column("data"), strict=True)]
            some = [i for i, f in enumerate(found) if len(f["group"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ablock").take(pa.array(some, pa.int32())), batch.column("leaf").take(pa.array(some, pa.int32())),
                 pa.array([_dump(**found[i]) for i in some], pa.binary())], ["ablock", "leaf", "found"])

    def together(packs: list[bytes]) -> dict[str, np.ndarray]:
        parts = [_load(p) for p in packs]
        return _best({name: np.concatenate([p[name] for p in parts]) for name in FOUND}, search.k)

    def reduce(t: pa.Table) -> pa.Table:
        return pa.table({"ablock": t["ablock"][:1], "found": pa.array([_dump(**together(t["found"].to_pylist()))], pa.binary())})

    def merge(s: pa.Table, t: pa.Table) -> pa.Table:
        data = s["state"].to_pylist()[0]
        if t.num_rows:
            before = _load(data)
            data = _dump(**{**before, **together([data, *t["found"].to_pylist()])})
        return pa.table({"ablock": s["ablock"], "state": pa.array([data], pa.binary())})

    found = pairs.select("ablock", "leaf", "asks", "data").mapInArrow(compare, "ablock long, leaf int, found binary")
    if tree.blocks.max(initial=0) > 1:      # the blocks of a leaf first, so that a group holds a row for each leaf at most
        found = found.groupBy("ablock", "leaf").applyInArrow(reduce, "ablock long, found binary")
    else:
        found = found.select("ablock", "found")
    with small_batches(spark, 16):
        return settle(state.groupBy("ablock").cogroup(found.groupBy("ablock")).applyInArrow(merge, "ablock long, state binary"))


def _searched(tree: Tree, blocks: DataFrame, state: DataFrame, search: Search) -> DataFrame:
    leaves, first = len(tree.paths), 0
    for width in (*WAVES, np.inf):
        if first < leaves:
            state = _wave(tree, blocks, state, search, first, first + width)
            first += width
    return state


def mine(rows: DataFrame, dims: int, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, v): one row for each anchor, positive and rank.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's score.
    """
    spark = rows.sparkSession
    tree, blocks = index(rows, dims, leaf_rows, fit_rows)
    state = _searched(tree, blocks, anchors_of(blocks, every), Search(positives, True, 1))

    def turn(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Finds become the positives of the next search: their places number the windows."""
        for batch in batches:
            out = []
            for data in batch.column("state"):
                s = _load(data.as_py())
                _, starts, counts = np.unique(s["group"], return_index=True, return_counts=True)
                slot = np.arange(len(s["group"])) - np.repeat(starts, counts)
                out.append(_dump(**{k: s[k] for k in ("id", "version", "label", "v")}, **_none(0),
                                 pgroup=s["group"] * positives + slot, pscore=s["score"], pid=s["fid"]))
            yield pa.RecordBatch.from_arrays([batch.column("ablock"), pa.array(out, pa.binary())], ["ablock", "state"])

    with small_batches(spark, 16):
        state = settle(state.mapInArrow(turn, "ablock long, state binary"))
    state = _searched(tree, blocks, state, Search(negatives, False, positives, low, high))

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("state"):
                s = _load(data.as_py())
                where = np.searchsorted(s["pgroup"], s["group"])
                _, starts, counts = np.unique(s["group"], return_index=True, return_counts=True)
                rank = np.arange(len(s["group"])) - np.repeat(starts, counts) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["id"][s["group"] // positives]), pa.array(s["pid"][where]), pa.array(rank, pa.int32()),
                     pa.array(s["fid"]), pa.array(s["pscore"][where]), pa.array(s["score"])],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return state.select("state").mapInArrow(
        rows_of, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


CHECK = """
WITH taken AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i]))::BIGINT AS score
  FROM taken a JOIN taken r ON a.id <> r.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) <= 10"""


@query("op12_hard_negatives", CHECK)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = 64
    rows = table(spark, sf_dir, "embeddings").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & complete(F.col("embedding"), dims))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"),
                            whole_numbers(F.col("embedding"), 256).alias("v")), dims)
