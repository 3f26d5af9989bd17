"""Registered queries: rule engine, input validation, dashboard figures, exports."""

from pyspark.sql import functions as F

from tradebook.functions.rules import Rule, issue_lines, validate_rules, validate_variant
from tradebook.operators import dashboard as D
from tradebook.operators import quality as Q
from tradebook.plans.records_queries import NAME_ERRORS, NAME_WARN, business_sql
from tradebook.plans.registry import query

RULES = {
    "id": Rule(int),
    "business_name": Rule(str, min_length=2, max_length=20),
    "place": Rule(dict, nested={
        "state": Rule(str, allowed=["CA", "NY"]),
        "zip_code": Rule(str, required=False, pattern=r"\d{5}"),
        "county": Rule(str),
    }),
    "verified": Rule(str, required=False),
    "created_at": Rule(str, check=lambda c: F.when(c == "n/a", F.lit("Date not available"))),
}

RULES_SQL = """list_filter([
  CASE WHEN length(business_name) < 2 THEN 'business_name: Length must be at least 2' END,
  CASE WHEN length(business_name) > 20 THEN 'business_name: Length must be at most 20' END,
  CASE WHEN state IS NULL THEN 'place.state: Required field is missing' WHEN state NOT IN ('CA', 'NY') THEN 'place.state: Value must be one of: [''CA'', ''NY'']' END,
  CASE WHEN zip_code IS NOT NULL AND NOT regexp_matches(zip_code, '^\\d{5}') THEN 'place.zip_code: Value does not match pattern' END,
  'place.county: Required field is missing',
  'verified: Invalid type. Expected str, got bool',
  CASE WHEN created_at = 'n/a' THEN 'created_at: Date not available' END], lambda x: x IS NOT NULL)"""


def _ruled(i):
    b = i.businesses.select("id", "business_name", F.struct("state", "zip_code").alias("place"),
                            "verified", "created_at")
    return validate_rules(b, RULES)


@query("validate_rules", f"SELECT id, array_to_string({RULES_SQL}, '; ') AS issues FROM @businesses")
def _(i):
    return _ruled(i).select("id", F.array_join(issue_lines(F.col("issues")), "; ").alias("issues"))


@query("validation_report", f"SELECT CAST(sum(len(e)) AS BIGINT) = 0 AS valid, CAST(sum(len(e)) AS BIGINT) AS error_count, 0::BIGINT AS warning_count FROM (SELECT {RULES_SQL} AS e FROM @businesses)")
def _(i):
    return Q.validation_report(_ruled(i))


@query("report_issues", f"SELECT id, split_part(x, ': ', 1) AS path, x[length(split_part(x, ': ', 1)) + 3:] AS message FROM (SELECT id, unnest({RULES_SQL}) AS x FROM @businesses)")
def _(i):
    return Q.report_issues(_ruled(i), "id")


@query("validate_variant", """SELECT doc_id, message IS NULL AS is_valid, CASE WHEN message IS NOT NULL THEN path END AS path, message FROM (SELECT doc_id,
  CASE WHEN length(text) > 1000 OR length(text) < 1 THEN '.body.text' WHEN doc_id % 5 = 0 THEN '.tags[1]' WHEN doc_id % 7 = 0 THEN '.note' END AS path,
  CASE WHEN length(text) > 1000 THEN 'String too long (max 1000)' WHEN length(text) < 1 THEN 'String too short (min 1)' WHEN doc_id % 5 = 0 THEN 'String too short (min 1)'
    WHEN doc_id % 7 = 0 THEN 'Type NoneType not allowed' END AS message FROM documents)""")
def _(i):
    value = F.to_json(F.struct(
        F.struct("text").alias("body"),
        F.array("lang", F.when(F.col("doc_id") % 5 == 0, "").otherwise("x")).alias("tags"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise("ok").alias("note")),
        {"ignoreNullFields": "false"})
    return i.documents.select("doc_id", validate_variant(value).alias("v")).select("doc_id", "v.*")


VALIDATED = f"""(SELECT v.id, v.business_name, v.e, v.w, row_number() OVER (PARTITION BY v.business_name ORDER BY v.id) > 1 AS dup
  FROM ({business_sql(True).replace("CASE WHEN created_at <> '' AND try_strptime(created_at, '%Y-%m-%d') IS NULL THEN ['Invalid created_at date format'] ELSE [] END", "[]")}) v)"""


@query("validate_input", f"SELECT id, nullif(array_to_string(e, '; '), '') AS errors, nullif(array_to_string(w, '; '), '') AS warnings, dup AS is_duplicate FROM {VALIDATED}")
def _(i):
    v = Q.validate_input(i.businesses)
    return v.select("id", F.nullif(F.array_join("errors", "; "), F.lit("")).alias("errors"),
                    F.nullif(F.array_join("warnings", "; "), F.lit("")).alias("warnings"), "is_duplicate")


@query("validate_input_names", f"SELECT id, nullif(array_to_string({NAME_ERRORS}, '; '), '') AS errors, CASE WHEN len({NAME_ERRORS}) = 0 THEN nullif(array_to_string({NAME_WARN}, '; '), '') END AS warnings FROM @businesses")
def _(i):
    v = Q.validate_input(i.businesses.select("id", "business_name"))
    return v.select("id", F.nullif(F.array_join("errors", "; "), F.lit("")).alias("errors"),
                    F.nullif(F.array_join("warnings", "; "), F.lit("")).alias("warnings"))


@query("input_totals", f"""SELECT count(*) AS total_rows, count(*) FILTER (len(e) = 0) AS valid_rows, count(*) FILTER (len(e) > 0) AS error_rows,
  count(*) FILTER (len(w) > 0) AS warning_rows, count(*) FILTER (dup) AS duplicate_rows, count(*) FILTER (len(e) > 0) = 0 AS is_valid FROM {VALIDATED}""")
def _(i):
    return Q.input_totals(Q.validate_input(i.businesses))


@query("error_table", f"SELECT id, business_name, unnest(e) AS error FROM {VALIDATED} WHERE len(e) > 0")
def _(i):
    return Q.error_table(Q.validate_input(i.businesses))


# --- dashboard ------------------------------------------------------------------------------

@query("business_kpis", """SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(DISTINCT state) + max((state IS NULL)::BIGINT) AS states,
  count(*) FILTER (TRY_CAST(try_strptime(created_at, '%Y-%m-%d') AS DATE) > DATE '2024-01-24' - 7) AS recent FROM @businesses""")
def _(i):
    return D.business_kpis(i.businesses, "2024-01-24", F.try_to_date("created_at", "y-M-d"))


for _c in ("state", "violation_type", "zip_code"):
    def _run(i, c=_c):
        return D.count_by(i.businesses, c)
    query(f"count_by_{_c}" if _c != "state" else "count_by_given_state",
          f"SELECT {_c}, count(*) AS count FROM @businesses GROUP BY {_c}")(_run)


@query("cleaning_stats", """SELECT count(*) AS total_items, count(*) FILTER (ok) AS valid_items, count(*) FILTER (NOT ok) AS invalid_items, 0::BIGINT AS processing_errors
  FROM (SELECT coalesce(business_name, '') <> '' AND coalesce(address, '') <> '' AND coalesce(created_at, '') <> '' AS ok FROM @businesses)""")
def _(i):
    from tradebook.functions.base import blank
    return D.cleaning_stats(i.businesses, ~blank("business_name") & ~blank("address") & ~blank("created_at"))


@query("run_stats", """SELECT *, businesses_total - processed_businesses AS businesses_remaining FROM (SELECT count(*) AS processed_businesses, count(*) FILTER (ok = 1) AS successful_searches, count(*) FILTER (ok = 0) AS failed_searches,
  CAST(sum(v) AS BIGINT) AS valid_urls, CAST(sum(iv) AS BIGINT) AS invalid_urls, CAST(sum(s) AS BIGINT) AS successful_scrapes, CAST(sum(f) AS BIGINT) AS failed_scrapes, (SELECT count(*) FROM customer) AS businesses_total FROM (
  SELECT business_id, max((title <> 'Co')::INTEGER) AS ok, count(*) FILTER (u) AS v, count(*) FILTER (NOT u) AS iv, count(*) FILTER (sc) AS s, count(*) FILTER (NOT sc) AS f FROM (
    SELECT business_id, title, regexp_matches(url, '^https?://[^/?#]+') AS u, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN pos % 3 = 0 END AS sc FROM @search_results) GROUP BY business_id))""")
def _(i):
    from tradebook.functions.checks import is_valid_url
    ok = is_valid_url("url")
    r = i.search_results.select("business_id", ok.alias("url_ok"), (F.col("title") != "Co").alias("searched_ok"),
                                F.when(ok, F.col("pos") % 3 == 0).alias("scraped_ok"))
    return D.run_stats(r, i.customer.agg(F.count(F.lit(1))).scalar())


@query("error_counts", f"SELECT unnest(e) AS error_type, count(*) AS count FROM {VALIDATED} GROUP BY 1")
def _(i):
    return D.error_counts(Q.error_table(Q.validate_input(i.businesses)).withColumnRenamed("error", "error_type"))


@query("search_businesses", "SELECT * FROM @businesses ORDER BY created_at DESC, id LIMIT 1000")
def _(i):
    return D.search_businesses(i.businesses, "created_at", descending=True)


@query("export_businesses", "SELECT id, business_name, address, state, zip_code, created_at FROM @businesses WHERE verified")
def _(i):
    return D.export_businesses(i.businesses, verified_only=True)
