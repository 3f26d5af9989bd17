"""Session construction and scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tradebook", cpus: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and benches; on a cluster pass in the submitted session."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where the session names none, a session inside one process (master ``local[...]``) gets a temporary
    folder, one for each application; on a cluster this is an error, since every executor would write to
    a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="tradebook-")
    return _FALLBACK[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Paths written by settle inside open scratch_tables blocks, the innermost last.
_SETTLED: list[list[str]] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where two branches must see the very same rows (for example partition ids of a
    sampled range exchange); the written files survive lost executors.
    """
    spark = df.sparkSession
    path = scratch(spark, "settled")
    if _SETTLED:
        _SETTLED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables that settle writes inside the block when it ends.

    Yields a function that marks the table settled last to stay (it then belongs to the block around, if
    any). What a block returns may read kept tables only.
    """
    mine: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(mine[-1])
        return df

    _SETTLED.append(mine)
    try:
        yield keep
    finally:
        _SETTLED.pop()
        if _SETTLED:
            _SETTLED[-1].extend(kept)
        for path in mine:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
