"""Centroid clustering: Lloyd's rounds with the dimensions dealt into column blocks.

Vectors are integers. They are written once, packed: one row for each (chunk of vectors, column block). In
every round a block's tasks know the centroids' slices of their own columns only and give the exact partial
distances of their chunk to all centroids. The blocks' partial distances are added by chunk, the least sum
is the assignment (ties: the smaller number), and each block sums its own columns by cluster: a shard updates
its own slices, which are all that comes back to the driver (clusters x dimensions numbers).

A chunk holds at most ``CHUNK`` vectors, so a task's memory is bounded and no key can be hot: the only keys
are chunks, and (block, cluster) after a combine in every task. Packed numbers take the smallest integer type
that holds them. Packed vectors and the last assignment are written to the shared folder, so a lost executor
costs its tasks only.

Components beyond ``LIMIT`` in size are set to it, so that distances fit into 64 bits. Rows of another length
than ``dims`` and rows with a null or non-finite component take no part. Repeated rows and rows with a null id
count one by one; ties between starting vectors go to the smaller components. With fewer vectors than
clusters there are fewer clusters; without vectors there are no rows. Inertia beyond 64 bits is null. Only the
id and the named results are returned, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.llm.common import query, small_batches, table
from tradebook.session import settle

#: Vectors packed into one row for each block.
CHUNK = 4096
#: Columns of a block.
BLOCK = 32
#: Largest size of a component: the sum of 1,024 squared differences still fits into 64 bits.
LIMIT = 1 << 25
#: Dimensions beyond which sums of squares could leave 64 bits.
MOST_DIMS = 1024


@dataclass(frozen=True)
class Packed:
    """Packed vectors: ``rows`` has (chunk, block, n, width, kind, data, ids); ids stand in block 0 only."""

    rows: DataFrame
    dims: int
    block: int

    @property
    def blocks(self) -> list[range]:
        return [range(at, min(at + self.block, self.dims)) for at in range(0, self.dims, self.block)]


def complete(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none of them null or non-finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component as a double, held within ``LIMIT``."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * F.lit(float(scale)), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))))


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them all."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, width)


def pack(vectors: DataFrame, dims: int, block: int = BLOCK, chunk: int = CHUNK) -> Packed:
    """Write ``vectors`` (columns ``id`` and ``v``, whole numbers of ``dims`` components) in column blocks."""
    if not 0 < dims <= MOST_DIMS:
        raise ValueError(f"between 1 and {MOST_DIMS} dimensions can be summed exactly, not {dims}")
    id_type = vectors.schema["id"].dataType
    cuts = [(at, min(at + block, dims)) for at in range(0, dims, block)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                slices = [_narrow(np.ascontiguousarray(v[:, a:b])) for a, b in cuts]
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(cuts), pa.int64()), pa.array(range(len(cuts)), pa.int32()),
                    pa.array([len(v)] * len(cuts), pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()),
                    pa.array([s.dtype.str for s in slices]), pa.array([s.tobytes() for s in slices], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * len(cuts)], pa.int32()), ids)],
                    names=["chunk", "block", "n", "width", "kind", "data", "ids"])
                number += 1

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("width", T.IntegerType()), T.StructField("kind", T.StringType()),
        T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])
    with small_batches(vectors.sparkSession, chunk):
        rows = settle(vectors.select("id", "v").mapInArrow(run, schema))
    return Packed(rows, dims, block)


def _partial(packed: Packed, centroids: np.ndarray, with_ids: bool) -> DataFrame:
    """Squared distances of every chunk to all centroids, over the columns of one block each."""
    slices = [np.ascontiguousarray(centroids[:, b.start:b.stop]) for b in packed.blocks]
    k = len(centroids)
    columns = ["chunk", "block", "kind", "data", "width", *(["ids"] if with_ids else [])]
    keep = packed.rows.select(*columns)
    fields = [T.StructField("chunk", T.LongType()), T.StructField("kind", T.StringType()),
              T.StructField("data", T.BinaryType()), *([keep.schema["ids"]] if with_ids else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                block, kind, data, width = (row.column(c)[0].as_py() for c in ("block", "kind", "data", "width"))
                v = _matrix(kind, data, width).astype(np.int64)
                out = np.empty((len(v), k), dtype=np.int64)
                for c in range(k):
                    apart = v - slices[block][c]
                    out[:, c] = np.einsum("ij,ij->i", apart, apart)
                out = _narrow(out)
                yield pa.RecordBatch.from_arrays(
                    [row.column("chunk"), pa.array([out.dtype.str]), pa.array([out.tobytes()], pa.binary()),
                     *([row.column("ids")] if with_ids else [])], [f.name for f in fields])

    return keep.mapInArrow(run, T.StructType(fields))


def _least(parts: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Add the blocks' partial distances; the nearest centroid (the first of equals) and its distance."""
    total = sum(_matrix(kind, data, k).astype(np.int64)
                for kind, data in zip(parts["kind"].to_pylist(), parts["data"].to_pylist(), strict=True))
    nearest = total.argmin(axis=1)
    return nearest, total[np.arange(len(total)), nearest]


def assign_chunks(packed: Packed, centroids: np.ndarray) -> DataFrame:
    """The nearest centroid of every vector, packed: (chunk, nearest), the latter as 4-byte integers."""
    k = len(centroids)

    def add(parts: pa.Table) -> pa.Table:
        nearest, _ = _least(parts, k)
        return pa.table({"chunk": parts["chunk"][:1], "nearest": pa.array([nearest.astype("<i4").tobytes()], pa.binary())})

    return _partial(packed, centroids, False).groupBy("chunk").applyInArrow(add, "chunk long, nearest binary")


def update(packed: Packed, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each block's own slices of the new centroids: exact ``floor(sum / count)``; empty clusters stay."""
    k, width = len(centroids), packed.block
    both = packed.rows.select("chunk", "block", "kind", "data", "width").join(assigned, "chunk")
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("n", T.LongType()),
                           *[T.StructField(f"s{j}", T.LongType()) for j in range(width)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.select(["block", "kind", "data", "width", "nearest"]).to_pylist():
                v = _matrix(row["kind"], row["data"], row["width"]).astype(np.int64)
                nearest = np.frombuffer(row["nearest"], dtype="<i4")
                held = sums.setdefault(row["block"], np.zeros((k, 1 + width), dtype=np.int64))
                order = np.argsort(nearest, kind="stable")
                found, starts = np.unique(nearest[order], return_index=True)
                held[found, 1:1 + row["width"]] += np.add.reduceat(v[order], starts, axis=0)
                held[found, 0] += np.diff(np.append(starts, len(order)))
        for block, held in sums.items():
            some = np.flatnonzero(held[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(some), pa.int32()), pa.array(some, pa.int32()),
                 *[pa.array(held[some, j]) for j in range(1 + width)]], schema.names)

    total = both.mapInArrow(run, schema).groupBy("block", "cluster").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    # floor(sum / count) in whole numbers: the remainder goes first
    means = [F.expr(f"(s{j} - pmod(s{j}, n)) div n").alias(f"s{j}") for j in range(width)]
    fresh = centroids.copy()
    for row in total.select("block", "cluster", *means).collect():
        columns = packed.blocks[row["block"]]
        fresh[row["cluster"], columns.start:columns.stop] = [row[f"s{j}"] for j in range(len(columns))]
    return fresh


def assign(packed: Packed, centroids: np.ndarray) -> DataFrame:
    """One row for each vector: its id, number of the nearest centroid and squared distance."""
    k = len(centroids)
    id_type = packed.rows.schema["ids"].dataType.elementType

    def add(parts: pa.Table) -> pa.Table:
        nearest, distance = _least(parts, k)
        ids = pa.concat_arrays([c.flatten() for c in parts["ids"].chunks])
        return pa.table({"id": ids, "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(distance)})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    return _partial(packed, centroids, True).groupBy("chunk").applyInArrow(add, schema)


def starting_centroids(vectors: DataFrame, order: Column, k: int) -> np.ndarray:
    """The ``k`` first vectors by ``order``."""
    rows = vectors.select(order.alias("o"), "v").orderBy("o", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def lloyd(vectors: DataFrame, order: Column, dims: int, k: int = 16, rounds: int = 3,
          block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """Cluster ``vectors`` (``id``, ``v``): the assignment after ``rounds`` updates, written, and the centroids."""
    packed = pack(vectors, dims, block, chunk)
    centroids = starting_centroids(vectors, order, k)
    with small_batches(vectors.sparkSession, 16):
        for _ in range(rounds if len(centroids) else 0):
            centroids = update(packed, assign_chunks(packed, centroids), centroids)
        if not len(centroids):
            schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()),
                                   T.StructField("distance", T.LongType())])
            return vectors.sparkSession.createDataFrame([], schema), centroids
        return settle(assign(packed, centroids)), centroids


def _check(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    nearest = """
  SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d
  FROM (SELECT v.vec_id, s.c, sum((v.x - s.x) * (v.x - s.x))::BIGINT AS d
        FROM comps v JOIN c{n} s ON v.j = s.j GROUP BY v.vec_id, s.c) GROUP BY vec_id"""
    steps = ""
    for n in range(rounds):
        steps += f""", a{n} AS ({nearest.format(n=n)}
), m{n} AS (SELECT a.c, v.j, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n
           FROM a{n} a JOIN comps v ON a.vec_id = v.vec_id GROUP BY a.c, v.j
), c{n + 1} AS (SELECT o.c, o.j, coalesce(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT, o.x) AS x
           FROM c{n} o LEFT JOIN m{n} m ON o.c = m.c AND o.j = m.j
)"""
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), comps AS (
  SELECT vec_id, unnest(range({dims})) AS j, unnest(v) AS x FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS c
  FROM (SELECT vec_id, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})
), c0 AS (
  SELECT f.c, v.j, v.x FROM first f JOIN comps v ON f.vec_id = v.vec_id
){steps}, last AS ({nearest.format(n=rounds)}
), shas AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY c
)
SELECT l.vec_id, l.c::INTEGER AS cluster, l.d AS distance,
       (sum(l.d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(l.d) OVER ())::BIGINT AS inertia,
       s.h AS centroid_sha256
FROM last l JOIN shas s ON l.c = s.c"""


@query("op11_sharded_lloyd", _check())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = 64
    vectors = table(spark, sf_dir, "embeddings").filter(complete(F.col("embedding"), dims)) \
        .select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding"), 64).alias("v"))
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    assigned, centroids = lloyd(vectors, order, dims)
    long = F.expr("try_cast(inertia AS bigint)")
    wide = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    by_cluster = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(wide)
                  .select("cluster", long.alias("inertia")).collect()}
    every = assigned.agg(wide).select(long.alias("inertia")).collect()[0]["inertia"]
    # one row for each centroid: bounded by the number of clusters
    about = spark.createDataFrame(
        [(c, by_cluster.get(c), ",".join(map(str, v.tolist()))) for c, v in enumerate(centroids)],
        "cluster int, cluster_inertia long, components string")
    return assigned.join(F.broadcast(about), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
        F.lit(every).cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
