"""Search queries, search results and their ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.address import extract_address, match_state, validate_address_parts
from tradebook.functions.base import blank, let, text, words
from tradebook.functions.checks import is_valid_url, validate_business
from tradebook.functions.scoring import basic_relevance, relevance_score
from tradebook.functions.text import (
    build_prompt,
    build_score_prompt,
    fallback_query,
    parse_model_query,
    parse_model_score,
)
from tradebook.plans.scale import first_rows

RESULT = "struct<pos:bigint,url:string,title:string,description:string,relevance_score:double>"


def query_variations(df: DataFrame, name: str = "business_name", state: str | None = None) -> DataFrame:
    """All search queries of every name, numbered in the order they are tried."""
    patterns = fixed.SITE_QUERIES + fixed.BASE_QUERIES \
        + (fixed.STATE_QUERIES if state else []) + fixed.QUOTED_QUERIES

    def fill(p: str) -> Column:
        head, tail = p.replace("{s}", state or "").split("{n}")
        return F.concat(F.lit(head), F.col(name), F.lit(tail))

    return df.select("*", F.posexplode(F.array(*[fill(p) for p in patterns])).alias("position", "query"))


def enhance_queries(df: DataFrame, model: Callable[[Column], Column] | None = None,
                    name: str = "business_name") -> DataFrame:
    """Add ``search_query``: the model's usable answer, else the fallback query.

    ``model`` maps the prompt column to the answer column, for example a Pandas UDF around a
    model loaded once per worker; without one every row takes the fallback.
    """
    answer = parse_model_query(model(build_prompt(name))) if model else F.lit(None).cast("string")
    return df.withColumn("search_query", F.coalesce(answer, fallback_query(name))) \
        .withColumn("enhancement", F.when(answer.isNotNull(), "model").otherwise("fallback"))


def score_results(df: DataFrame, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``relevance_score`` by the model, or by keywords when there is none."""
    if model is None:
        score = basic_relevance("title", "description", "url")
    else:
        score = parse_model_score(model(build_score_prompt("title", "description", "url")))
    return df.withColumn("relevance_score", score)


def members(df: DataFrame, col: str, allowed: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value is (or is not) in the first column of ``allowed``."""
    known = allowed.select(F.col(allowed.columns[0]).alias(col))
    return df.join(known, col, "left_semi" if inside else "left_anti")


def dedup_results(df: DataFrame) -> DataFrame:
    """First result (by pos) per business and URL; blank and invalid URLs are dropped."""
    return first_rows(df.filter(~blank("url") & is_valid_url("url")), ["business_id", "url"], ["pos"])


def top_results(df: DataFrame, k: int = 10,
                score: Callable[[], Column] | None = None) -> DataFrame:
    """Best ``k`` distinct results per business with rank and the number of distinct results.

    The total is a separate partial aggregate, so a business with very many results never has
    them all in one window; the ranking itself is cut to ``k`` per task before the shuffle.
    """
    value = score() if score else relevance_score("business_name", "title", "description", "url")
    scored = dedup_results(df).withColumn("relevance_score", value)
    totals = scored.groupBy("business_id").agg(F.count(F.lit(1)).alias("total_results"))
    order = [F.desc("relevance_score"), F.asc("pos")]
    best = first_rows(scored, ["business_id"], order, k)
    return best.join(totals, "business_id")


def nest_results(names: DataFrame, top: DataFrame) -> DataFrame:
    """One envelope per business: items in rank order and a metadata struct.

    ``top`` must already be limited per business (top_results), so the items stay few. Names
    without results get an empty envelope.
    """
    item = F.struct((-F.col("relevance_score")).alias("_o"), "pos", "url", "title", "description",
                    "relevance_score")
    packed = top.groupBy("business_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.max("total_results").alias("total_results"))
    joined = names.select("business_id", "business_name").join(packed, "business_id", "left")
    items = F.transform(F.coalesce("items", F.array().cast("array<struct<_o:double,pos:bigint,url:string,"
                                   "title:string,description:string,relevance_score:double>>")),
                        lambda e: F.struct(e["pos"].alias("pos"), e["url"].alias("url"), e["title"].alias("title"),
                                           e["description"].alias("description"),
                                           e["relevance_score"].alias("relevance_score")))
    meta = F.struct("business_name", F.coalesce("total_results", F.lit(0)).alias("total_results"))
    return joined.select("business_id", F.struct(F.struct(F.struct(
        items.alias("items"), meta.alias("metadata")).alias("result")).alias("data")).alias("envelope"))


def flatten_results(nested: DataFrame) -> DataFrame:
    """Rows of the envelopes; an empty envelope gives one row with NULL result fields."""
    r = F.col("envelope.data.result")
    return nested.select("business_id", r["metadata"]["business_name"].alias("business_name"),
                         r["metadata"]["total_results"].alias("total_results"),
                         F.posexplode_outer(r["items"]).alias("rank", "item")) \
        .select("business_id", "business_name", "total_results", "rank", "item.*")


def resolve_results(df: DataFrame, target_state: str | None = None, word_boundary: bool = True,
                    propagate_address_errors: bool = False) -> DataFrame:
    """Outcome per result: ``resolved`` with an address row, ``needs_fetch``, or ``rejected``.

    A result with a usable URL whose title and description hold a valid address (in the wanted
    state) becomes a business row; a usable URL without one still has to be fetched; an invalid
    URL or an invalid business record is rejected.
    """
    parts = extract_address(F.concat(text("title"), F.lit("\n"), text("description")), word_boundary)
    found = df.withColumn("_p", parts)
    p = F.col("_p")
    address_ok = p.isNotNull() & validate_address_parts(p["street"], p["city"], p["state"], p["zip_code"])["is_valid"]
    if target_state:
        address_ok = address_ok & match_state(p["state"], target_state)["is_valid"]
    record_ok = validate_business(F.col("business_name"), p["street"],
                                  propagate_address_errors=propagate_address_errors)["is_valid"]
    outcome = F.when(~is_valid_url("url"), "rejected") \
        .when(F.coalesce(address_ok, F.lit(False)), F.when(record_ok, "resolved").otherwise("rejected")) \
        .otherwise("needs_fetch")
    staged = found.withColumn("outcome", outcome)
    hit = F.col("outcome") == "resolved"
    return staged.select(
        "business_id", "pos", F.col("business_name").alias("name"), "outcome",
        F.when(hit, p["street"]).alias("address"), F.when(hit, p["state"]).alias("state"),
        F.when(hit, p["zip_code"]).alias("zip_code"), F.when(hit, F.lit(1.0)).alias("confidence"),
        F.col("url").alias("source_url"))


def verify_page_results(df: DataFrame, body: str, word_boundary: bool = True) -> DataFrame:
    """Rows whose text holds a valid address, marked verified.

    ``body`` is the text column; business_name, url and relevance_score are carried along.
    """
    staged = df.withColumn("_p", extract_address(F.col(body), word_boundary)).filter(F.col("_p").isNotNull())
    p = F.col("_p")
    ok = validate_address_parts(p["street"], p["city"], p["state"], p["zip_code"])["is_valid"]
    return staged.filter(ok).select(
        "business_name", p["street"].alias("address"), p["city"].alias("city"), p["state"].alias("state"),
        p["zip_code"].alias("zip_code"), F.col("url").alias("source_url"), "relevance_score",
        F.lit(True).alias("verified"), F.lit("webpage").alias("source"))


def match_result_name(df: DataFrame, body: str = "title") -> DataFrame:
    """Per business the URL of the first result whose text contains any word of the name."""
    low = F.lower(text(body))
    hit = let(words(F.lower(text("business_name"))), lambda ws: F.exists(ws, lambda w: low.contains(w)))
    return df.filter(hit & ~blank("url")).groupBy("business_id").agg(
        F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"))


def first_source(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per business the first non-blank address by source priority, '' where there is none.

    Needs business_id in both, address and priority (lower is tried first) in the candidates.
    """
    best = candidates.filter(~blank(F.trim("address"))).groupBy("business_id").agg(
        F.min_by("address", "priority").alias("address"))
    return names.join(best, "business_id", "left").withColumn("address", text("address"))


def fill_results(names: DataFrame, results: DataFrame, row: str = "row_id") -> DataFrame:
    """Every input row with its found address, '' where nothing was found."""
    picked = results.select(row, F.col("address").alias("_found"))
    return names.join(picked, row, "left").withColumn("address", text("_found")).drop("_found")
