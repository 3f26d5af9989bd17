"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Broadcast an id list only up to this many rows (8 bytes each, 8 MB); beyond it Spark shuffles.
BROADCAST_IDS = 1_000_000


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say it, its check."""
    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """The fold of a row: crc32 of its key as text (empty for null), modulo ``parts``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def unit(seed: str, *keys: Column) -> Column:
    """A repeatable number in [0, 1) from the keys: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: str = "sample") -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key (all rows where there are fewer)."""
    n = df.count()
    return df if n <= bound else df.filter(unit(seed, key) < F.lit(bound / n))


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the written table ``ids``; broadcast when its size allows."""
    return df.join(_side(ids, key), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the first column of the written table ``ids``."""
    return df.join(_side(ids, key), key, "left_anti")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Arrow batches of few rows for the jobs run inside: rows that hold texts or sets are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _side(ids: DataFrame, key: str) -> DataFrame:
    side = ids.select(F.col(ids.columns[0]).alias(key))
    return F.broadcast(side) if ids.count() <= BROADCAST_IDS else side
