"""Business-record operators (DataFrame -> DataFrame)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.address import normalize_state, parse_state_zip
from tradebook.functions.base import blank, strip, text
from tradebook.functions.text import business_key, record_label, url_domain
from tradebook.plans.scale import first_rows
from tradebook.session import settle


def with_missing_columns(df: DataFrame, columns: Sequence[str] = tuple(fixed.BUSINESS_COLUMNS)) -> DataFrame:
    """The given columns in order; those the input lacks are NULL texts."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in columns])


def clean_business(df: DataFrame, keep_given: bool = True, word_boundary: bool = True) -> DataFrame:
    """Drop incomplete records, trim, fill state and ZIP from the address.

    When only one of state and ZIP is given, ``keep_given=True`` keeps it (normalised) and
    ``keep_given=False`` drops it.
    """
    required = (F.coalesce(F.col("id") != 0, F.lit(False)) & ~blank("business_name")
                & ~blank("address") & ~blank("created_at"))
    extra = [c for c in df.columns if c not in fixed.BUSINESS_COLUMNS]
    base = with_missing_columns(df, [*fixed.BUSINESS_COLUMNS, *extra]).filter(required).withColumns({
        "business_name": strip("business_name"), "address": strip("address")})
    parsed = base.withColumn("_p", parse_state_zip("address", word_boundary))
    partial = blank("state") | blank("zip_code")
    given_state = normalize_state(strip("state"))
    given_zip = strip("zip_code")
    found_state, found_zip = normalize_state(F.col("_p.state")), F.col("_p.zip_code")
    kept = F.lit(None).cast("string")
    return parsed.select(
        "id", "business_name",
        F.when(partial & ~blank("_p.clean_address"), F.col("_p.clean_address"))
        .otherwise(F.col("address")).alias("address"),
        F.when(~partial, given_state).when(blank("state"), found_state)
        .otherwise(given_state if keep_given else kept).alias("state"),
        F.when(~partial, given_zip).when(blank("zip_code"), found_zip)
        .otherwise(given_zip if keep_given else kept).alias("zip_code"),
        "created_at", *extra)


def coerce_record(df: DataFrame) -> DataFrame:
    """Trim all texts, upper-case the state, digit texts become ids, blank optionals NULL."""
    id_text = F.col("id").cast("string")
    return df.withColumns({
        "id": F.when(id_text.rlike(r"^\d+\z"), id_text.try_cast("bigint")),
        "business_name": strip("business_name"), "address": strip("address"),
        "created_at": strip("created_at"),
        "state": F.when(~blank("state"), F.upper(strip("state"))),
        "zip_code": F.when(~blank("zip_code"), strip("zip_code")),
    })


def format_business(df: DataFrame, as_of: str) -> DataFrame:
    """Nested record with a metadata struct; ``as_of`` is the extraction time text.

    Needs name, street, city, state, zip_code, confidence, source_url.
    """
    return df.select(
        F.col("name"), text("street").alias("address"), text("city").alias("city"),
        text("state").alias("state"), text("zip_code").alias("zip_code"), "confidence", "source_url",
        F.struct(F.lit("search_result").alias("source"), F.lit(as_of).alias("extracted_at"),
                 url_domain("source_url").alias("domain")).alias("metadata"))


def record_json(df: DataFrame, columns: Sequence[str] = tuple(fixed.BUSINESS_COLUMNS)) -> Column:
    """JSON text of the record without its NULL fields."""
    return F.to_json(F.struct(*[F.col(c) for c in columns if c in df.columns]))


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", record_label("business_name", "address", "state", "zip_code",
                                               id="id", created="created_at"))


def dedup_businesses(df: DataFrame, order: str = "id") -> DataFrame:
    """Keep the first record (by ``order``) of every name-and-address key."""
    return first_rows(df.withColumn("_key", business_key("business_name", "address")),
                      ["_key"], [order]).drop("_key")


def mark_duplicates(df: DataFrame, col: str, order: str = "id") -> DataFrame:
    """Add ``is_duplicate``: True for the second and later rows of a value.

    The first row of each repeated value is found with a partial aggregate and joined back, so
    no value's rows have to meet in one task.
    """
    firsts = df.groupBy(F.col(col).alias("_value")).agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(firsts, F.col(col).eqNullSafe(F.col("_value")), "left").withColumn(
        "is_duplicate", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))) \
        .drop("_value", "_first")


def duplicate_summary(df: DataFrame, col: str, order: str = "id") -> DataFrame:
    """The repeated rows of a column (after the first), written once, beside their total number."""
    repeated = settle(mark_duplicates(df, col, order).filter("is_duplicate").select(order, col))
    total = repeated.agg(F.count(F.lit(1)).alias("n"))
    return repeated.withColumn("total_duplicates", total.scalar())


def union_chunks(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of record sets with the fixed column order."""
    out = with_missing_columns(frames[0])
    for f in frames[1:]:
        out = out.unionByName(with_missing_columns(f))
    return out


def collect_query_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of cached and fresh result sets; columns only one side has become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def found_count(df: DataFrame, col: str = "address") -> DataFrame:
    return df.agg(F.count_if(~blank(col)).alias("addresses_found"), F.count(F.lit(1)).alias("rows"))
