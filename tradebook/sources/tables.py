"""Database tables over JDBC and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def jdbc_options(url: str, user: str | None = None, password: str | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Connection options for a JDBC URL; the driver class follows from the URL."""
    kind = url.split(":")[1]
    out = {"url": url, "fetchsize": str(fetch_size)}
    if kind in DRIVERS:
        out["driver"] = DRIVERS[kind]
    if user is not None:
        out["user"] = user
    if password is not None:
        out["password"] = password
    return out


def split_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Read in parallel ranges of a numeric or date column instead of one connection."""
    if partitions < 1 or upper < lower:
        raise ValueError("need partitions >= 1 and upper >= lower")
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(partitions)}


def read_table_jdbc(spark: SparkSession, url: str, table_or_query: str, split: dict[str, str] | None = None,
                    **credentials) -> DataFrame:
    """A table, or the rows of a SELECT (wrapped as a sub-query so that it can be split)."""
    target = table_or_query
    if " " in target.strip():
        target = f"({target.strip().rstrip(';')}) AS q"
    return spark.read.format("jdbc").options(
        **jdbc_options(url, **credentials), **(split or {}), dbtable=target).load()


def write_table_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 5000,
                     **credentials) -> None:
    df.write.format("jdbc").options(**jdbc_options(url, **credentials), dbtable=table,
                                    batchsize=str(batch_size)).mode(mode).save()


def table_profile(df: DataFrame) -> DataFrame:
    """(column, type, nullable, rows, nulls) per column, counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                              F.lit(f.nullable).alias("nullable"), F.col("_rows").alias("rows"),
                              F.col(f"`{f.name}`").alias("nulls")) for f in df.schema.fields])
    return counts.select(F.inline(rows))


def catalog_profile(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, size_bytes, rows) of the catalog's tables, largest first, from analysed statistics."""
    out = []
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        if t.isTemporary:
            continue
        name = ".".join(f"`{p}`" for p in (*(t.namespace or []), t.name))
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
        stats = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'").select("data_type").first()
        parts = (stats[0] if stats else "0 bytes").replace(",", "").split()
        out.append((t.name, int(parts[0]), int(parts[2]) if len(parts) > 2 else None))
    return spark.createDataFrame(out, "table string, size_bytes bigint, rows bigint").orderBy(F.desc("size_bytes"))
