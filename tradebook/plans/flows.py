"""End-to-end jobs composed from the operators; each is one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.checks import is_iso_date
from tradebook.operators.pages import flag_challenge_pages, flag_no_results, from_next_data, from_selectors
from tradebook.operators.ranking import fill_results, first_source, resolve_results, top_results
from tradebook.operators.records import clean_business, dedup_businesses


def addresses_for_names(names: DataFrame, directory_pages: DataFrame, review_pages: DataFrame) -> DataFrame:
    """Every name row with the address its fetched pages give, '' where they give none.

    ``names`` has row_id and business_name; pages have page_id, row_id (whose search they answer),
    url and html. Bot walls and empty result pages are skipped; the directory is preferred, then
    the reviews site (page state first, then selectors).
    """
    listing = flag_no_results(flag_challenge_pages(directory_pages)).filter(~F.col("is_challenge") & ~F.col("no_results"))
    review = flag_challenge_pages(review_pages).filter(~F.col("is_challenge"))
    found = from_selectors(listing, fixed.DIRECTORY_SELECTORS, (), nested=False).withColumn("priority", F.lit(1)) \
        .join(listing.select("page_id", "row_id"), "page_id")
    state = from_next_data(review).withColumn("priority", F.lit(2))
    shown = from_selectors(review).withColumn("priority", F.lit(3))
    found = found.unionByName(state.unionByName(shown).join(review.select("page_id", "row_id"), "page_id"))
    best = first_source(names.select(F.col("row_id").alias("business_id")),
                        found.withColumnRenamed("row_id", "business_id"))
    return fill_results(names, best.withColumnRenamed("business_id", "row_id"))


def businesses_from_results(results: DataFrame, as_of: str, target_state: str | None = None, k: int = 10) -> DataFrame:
    """Clean, distinct business records out of raw search results.

    The best ``k`` results per business are resolved to addresses; the first resolved one (by
    rank) becomes the record.
    """
    ranked = top_results(results, k)
    hits = resolve_results(ranked, target_state).filter("outcome = 'resolved'") \
        .join(ranked.select("business_id", "pos", "relevance_score"), ["business_id", "pos"])
    first = hits.groupBy("business_id").agg(F.min_by(
        F.struct("name", "address", "state", "zip_code"), F.struct((-F.col("relevance_score")).alias("s"), "pos")).alias("r"))
    records = first.select(F.col("business_id").alias("id"), F.col("r.name").alias("business_name"), "r.address", "r.state",
                           "r.zip_code", F.lit(as_of).alias("created_at")).filter(is_iso_date("created_at"))
    return clean_business(dedup_businesses(records))
