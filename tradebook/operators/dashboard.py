"""Dashboard figures, searches and exports over business records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.operators.records import with_missing_columns


def count_by(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(col))


def business_kpis(df: DataFrame, as_of: str, created: str | Column = "created_at") -> DataFrame:
    """Total, verified, covered states (NULL counts as one) and rows created in the last 7 days.

    ``created`` must be a DATE; ``as_of`` is an ISO date.
    """
    created = F.col(created) if isinstance(created, str) else created
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("verified").alias("verified"),
        (F.count_distinct("state") + F.coalesce(F.max(F.col("state").isNull().cast("int")), F.lit(0))).alias("states"),
        F.count_if(created > F.date_sub(F.lit(as_of).cast("date"), 7)).alias("recent"))


def cleaning_stats(df: DataFrame, valid: Column, failed: Column | None = None) -> DataFrame:
    """Totals of a cleaning run: ``valid`` rows, invalid rows and rows that raised errors."""
    failed = F.lit(False) if failed is None else failed
    return df.agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(valid & ~failed).alias("valid_items"),
        F.count_if(~valid & ~failed).alias("invalid_items"), F.count_if(failed).alias("processing_errors"))


def with_cleaning_stats(df: DataFrame, valid: Column) -> tuple[DataFrame, Observation]:
    """The same rows with their totals observed while they are written: no second pass.

    Read the observation's ``get`` after the write.
    """
    seen = Observation("cleaning_stats")
    return df.observe(seen, F.count(F.lit(1)).alias("total_items"), F.count_if(valid).alias("valid_items"),
                      F.count_if(~valid).alias("invalid_items")), seen


def run_stats(df: DataFrame, total: int | Column | None = None) -> DataFrame:
    """Run counters from per-result outcomes.

    Needs business_id, url_ok, searched_ok, scraped_ok (NULL where nothing was scraped).
    """
    per = df.groupBy("business_id").agg(
        F.max(F.col("searched_ok").cast("int")).alias("ok"), F.count_if("url_ok").alias("v"),
        F.count_if(~F.col("url_ok")).alias("iv"), F.count_if(F.col("scraped_ok")).alias("s"),
        F.count_if(~F.col("scraped_ok")).alias("f"))
    out = per.agg(
        F.count(F.lit(1)).alias("processed_businesses"), F.count_if(F.col("ok") == 1).alias("successful_searches"),
        F.count_if(F.col("ok") == 0).alias("failed_searches"), F.sum("v").alias("valid_urls"),
        F.sum("iv").alias("invalid_urls"), F.sum("s").alias("successful_scrapes"),
        F.sum("f").alias("failed_scrapes"))
    if total is not None:
        total = F.lit(total) if isinstance(total, int) else total
        out = out.withColumn("businesses_total", total).withColumn(
            "businesses_remaining", F.col("businesses_total") - F.col("processed_businesses"))
    return out


def error_counts(df: DataFrame, col: str = "error_type") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def search_businesses(df: DataFrame, sort_by: str = "id", descending: bool = False,
                      limit: int = 1000) -> DataFrame:
    """The sorted first ``limit`` records; only the six listed columns can be sorted by."""
    if sort_by not in fixed.BUSINESS_COLUMNS:
        raise ValueError(f"cannot sort by {sort_by!r}")
    key = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return df.orderBy(key, F.col("id").asc()).limit(limit)


def export_businesses(df: DataFrame, verified_only: bool = False) -> DataFrame:
    """The six export columns, newest first; written with sources.files.write_export."""
    picked = df.filter("verified") if verified_only else df
    return with_missing_columns(picked).orderBy(F.desc("created_at"), F.asc("id"))


def format_timestamps(df: DataFrame, columns: Sequence[str] = tuple(fixed.DISPLAY_DATE_COLUMNS)) -> DataFrame:
    """Display text for the listed time columns that exist."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns if c in df.columns})
