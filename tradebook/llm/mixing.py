"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted ``weight(s) * total / rows(s)`` times on average. Its number of copies
is a Poisson number with that mean, found by inverting the distribution at a uniform number that is
hashed from the seed and the document's id, so a rerun, a retry or another partitioning gives the same
copies. Documents are exploded by their count and dealt out in the order of a second hash: a global
shuffle that reads the same whenever it is run.

The only aggregate is the row count of the sources. A null source is a source of its own. Sources
without a weight (or with weight 0) get no copies; where no weights are given, a source weighs its row
count to the power ``temperature``. Rows with the same id share their uniform number. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import query, table, unit
from tradebook.session import settle

#: Production parameters of the query and the stage.
TEMPERATURE, SEED = 0.5, "mix-1"
#: Broadcast the rates of up to this many sources.
BROADCAST_SOURCES = 100_000


def rates(documents: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None,
          temperature: float = TEMPERATURE) -> DataFrame:
    """(_mx_source, _mx_rate): the mean number of copies that a document of the source is wanted."""
    counts = documents.groupBy(F.col("source").alias("_mx_source")).agg(F.count("*").alias("_mx_n"))
    if weights is None:
        weighed = counts.withColumn("_mx_w", F.pow(F.col("_mx_n").cast("double"), F.lit(temperature)))
    else:
        pairs = [F.struct(F.lit(k).cast("string").alias("k"), F.lit(float(v)).alias("v")) for k, v in weights.items()]
        known = F.filter(F.array(*pairs), lambda p: p["k"].eqNullSafe(F.col("_mx_source"))) if pairs else None
        weighed = counts.withColumn("_mx_w", F.lit(0.0) if known is None else F.coalesce(F.get(known, 0)["v"], F.lit(0.0)))
    sums = weighed.agg(F.sum("_mx_w").alias("_mx_sum"), F.sum("_mx_n").alias("_mx_rows"),
                       F.count("*").alias("_mx_sources")).first()
    rows, weight = sums["_mx_rows"] or 0, sums["_mx_sum"] or 1.0
    wanted = float(rows if total is None else total)
    out = weighed.select("_mx_source", (F.col("_mx_w") / F.lit(weight) * F.lit(wanted) / F.col("_mx_n")).alias("_mx_rate"))
    # one row a source; with very many sources Spark decides how to join
    return F.broadcast(out) if sums["_mx_sources"] <= BROADCAST_SOURCES else out


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k whose Poisson distribution function exceeds ``u``.

    Terms are summed in logarithms, so large means do not underflow; the search ends where terms above the
    mean no longer change the sum in double precision.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("below"),
                     F.when(F.exp(-rate) > u, F.lit(0)).alias("k"))

    def add(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        below = acc["below"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), below.alias("below"),
                        F.coalesce(acc["k"], F.when((below > u) | (k > rate) & (log_p < -45), k)).alias("k"))

    counted = F.aggregate(F.sequence(F.lit(1), most), start, add, lambda acc: F.coalesce(acc["k"], most))
    return F.when(rate > 0, counted).otherwise(F.lit(0))


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None,
        temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """``documents`` with ``copy`` (from 0) and ``copies``, replicated and globally shuffled.

    Columns of ``documents`` called ``copy`` or ``copies`` are replaced.
    """
    keep = [c for c in documents.columns if c not in ("copy", "copies")]
    by_source = rates(documents, weights, total, temperature)
    rated = documents.select(*keep).join(by_source, F.col("source").eqNullSafe(F.col("_mx_source")))
    counted = rated.withColumn("_mx_u", unit(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) \
        .withColumn("copies", poisson_inverse(F.col("_mx_u"), F.col("_mx_rate"))).filter("copies > 0")
    exploded = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .withColumn("_mx_at", F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.col("doc_id").cast("string"), F.col("copy"))
                                    .cast("binary")))
    # the places are evenly spread, so the ranges of the partitions are known without a look at the rows
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("_mx_at", 1, 8), 16, 10).cast("double") * F.lit(parts / (1 << 32))).cast("int")
    return exploded.repartitionById(parts, part).sortWithinPartitions("_mx_at") \
        .drop("_mx_source", "_mx_rate", "_mx_u", "_mx_at")


OP9_SQL = f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
t AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
    FROM r, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS x(k)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM t),
u AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
    / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT u.doc_id, u.source, count(f.k)::INTEGER AS copies FROM u LEFT JOIN f
    ON f.source IS NOT DISTINCT FROM u.source AND f.below <= u.u GROUP BY u.doc_id, u.source, u.u)
SELECT doc_id, source, copies, unnest(range(0, copies))::INTEGER AS copy FROM k WHERE copies > 0"""


@query("op9_mix_sources", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole documents are replicated, shuffled and written; the check compares which copies there are
    return settle(mix(table(spark, sf_dir, "documents"))).select("doc_id", "source", "copies", "copy")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: documents with their copies, in shuffled order."""
    return mix(docs)
