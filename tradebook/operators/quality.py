"""Input validation, error tables and validation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.base import let, no_messages
from tradebook.functions.checks import name_errors, name_warnings, validate_business
from tradebook.functions.rules import required_columns
from tradebook.operators.records import mark_duplicates


def validate_input(df: DataFrame, row: str = "id", propagate_address_errors: bool = True) -> DataFrame:
    """Per-row errors and warnings of an input file's rows.

    ``row`` orders the rows. Rows without an address get only the name check; a repeated name
    is a warning on its second and later rows.
    """
    required_columns(df, ["business_name"])
    name = F.col("business_name")
    name_only = F.struct(name_errors(name).alias("errors"),
                         F.when(F.size(name_errors(name)) == 0, name_warnings(name))
                         .otherwise(no_messages()).alias("warnings"))
    if "address" in df.columns:
        full = validate_business(name, F.col("address"), propagate_address_errors=propagate_address_errors)
        both = let(full, lambda v: F.struct(v["errors"].alias("errors"), v["warnings"].alias("warnings")))
        verdict = F.when(F.col("address").isNotNull(), both).otherwise(name_only)
    else:
        verdict = name_only
    marked = mark_duplicates(df.withColumn("_v", verdict), "business_name", row)
    return marked.select(
        row, "business_name", *(["address"] if "address" in df.columns else []),
        F.col("_v.errors").alias("errors"), F.col("_v.warnings").alias("warnings"), "is_duplicate")


def input_totals(validated: DataFrame) -> DataFrame:
    """One row: totals of a validated input."""
    bad = F.size("errors") > 0
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(~bad).alias("valid_rows"),
        F.count_if(bad).alias("error_rows"), F.count_if(F.size("warnings") > 0).alias("warning_rows"),
        F.count_if("is_duplicate").alias("duplicate_rows"),
        (F.count_if(bad) == 0).alias("is_valid"))


def error_table(validated: DataFrame, row: str = "id") -> DataFrame:
    """One line per error of every failing row.

    Filtered after the explode: a filter on the errors, also the one Spark adds to a plain explode, would be
    pushed down to the checks and run them all a second time.
    """
    return validated.select(row, "business_name", F.explode_outer("errors").alias("error")) \
        .filter(F.col("error").isNotNull())


def validation_report(issues: DataFrame, col: str = "issues", warnings: Column | None = None) -> DataFrame:
    """Overall verdict with error and warning counts, one row."""
    n_warn = F.lit(0) if warnings is None else F.size(warnings)
    return issues.agg(
        (F.coalesce(F.sum(F.size(col)), F.lit(0)) == 0).alias("valid"),
        F.coalesce(F.sum(F.size(col)), F.lit(0)).alias("error_count"),
        F.coalesce(F.sum(n_warn), F.lit(0)).cast("bigint").alias("warning_count"))


def report_issues(issues: DataFrame, key: str, col: str = "issues") -> DataFrame:
    """The report's error list in long form: one row per issue, whole and unlimited."""
    return issues.select(key, F.explode(col).alias("_i")).select(key, "_i.path", "_i.message")
