"""Registered queries: search queries, result ranking, result resolution."""

from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions import scoring as S
from tradebook.functions.base import words
from tradebook.operators import ranking as G
from tradebook.plans.records_queries import NAME_ERRORS, VALID, extract_sql, street_ok
from tradebook.plans.registry import query


def _texts(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ALL = fixed.SITE_QUERIES + fixed.BASE_QUERIES + fixed.STATE_QUERIES + fixed.QUOTED_QUERIES


@query("query_variations", f"""SELECT id, CAST(p AS INTEGER) AS position, replace(replace({_texts(_ALL)}[p + 1], '{{n}}', business_name), '{{s}}', 'NY') AS query
  FROM @businesses, range({len(_ALL)}) r(p)""")
def _(i):
    return G.query_variations(i.businesses.select("id", "business_name"), state="NY").select("id", "position", "query")


def hits(body: str, values) -> str:
    return "(" + " + ".join(f"CAST(contains({body}, '{v}') AS INTEGER)" for v in values) + ")"


def any_hit(body: str, values) -> str:
    return "(" + " OR ".join(f"contains({body}, '{v}')" for v in values) + ")"


def share(terms: str, body: str) -> str:
    return f"(len(list_filter({terms}, lambda w: contains({body}, w))) / nullif(len({terms}), 0))"


RELEVANCE = f"""coalesce(round(least({share('terms', 'body')} * 0.4::DOUBLE + {hits('body', fixed.RELEVANCE_KEYWORDS)} * 0.02::DOUBLE
  + {' + '.join(f"CASE WHEN {any_hit('link', d)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for w, d in fixed.TRUST_TIERS)}, 1.0::DOUBLE), 3), 0.1::DOUBLE)"""
SCORED = """SELECT *, lower(title || ' ' || description) AS body, lower(url) AS link, list_filter(regexp_split_to_array(trim(lower(business_name)), '\\s+'), lambda w: w <> '') AS terms FROM @search_results"""


@query("relevance_score", f"SELECT pos, {RELEVANCE} AS score FROM ({SCORED})")
def _(i):
    return i.search_results.select("pos", S.relevance_score("business_name", "title", "description", "url").alias("score"))


_TRUST = "CASE " + " ".join(f"WHEN contains(host, '{d}') THEN {w}::DOUBLE" for d, w in fixed.TRUSTED_DOMAINS) + " ELSE 0.0::DOUBLE END"


@query("weighted_score", f"""SELECT pos, coalesce(round(least({share('terms', 'body')} * 0.4::DOUBLE + (0.0::DOUBLE + {' + '.join(f"{hits('body', g)} * {w}::DOUBLE" for w, g in fixed.KEYWORD_GROUPS)}) + {_TRUST}, 1.0::DOUBLE), 3), 0.1::DOUBLE) AS score
  FROM (SELECT *, regexp_extract(link, '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1) AS host FROM ({SCORED}))""")
def _(i):
    return i.search_results.select("pos", S.weighted_score(
        F.concat("title", F.lit(" "), "description"), "url", words(F.lower("business_name"))).alias("score"))


@query("basic_relevance", f"""SELECT pos, round(least({hits('body', fixed.BASIC_KEYWORDS)} / 10.0::DOUBLE + (CASE WHEN {any_hit('link', fixed.BASIC_DOMAINS)} THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN {any_hit('lower(title)', fixed.BASIC_TITLE_TERMS)} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 1.0::DOUBLE), 2) AS score FROM ({SCORED})""")
def _(i):
    return i.search_results.select("pos", S.basic_relevance("title", "description", "url").alias("score"))


UNIQUE = f"""(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY business_id, url ORDER BY pos) AS rn FROM ({SCORED}) WHERE regexp_matches(url, '^https?://[^/?#]+')) WHERE rn = 1)"""
TOP = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY relevance_score DESC, pos) AS rk, count(*) OVER (PARTITION BY business_id) AS total_results
  FROM (SELECT *, {RELEVANCE} AS relevance_score FROM {UNIQUE})) WHERE rk <= 10)"""


@query("dedup_results", f"SELECT business_id, business_name, pos, url, title, description FROM {UNIQUE}")
def _(i):
    return G.dedup_results(i.search_results)


@query("top_results", f"SELECT business_id, business_name, pos, url, title, description, relevance_score, total_results FROM {TOP}")
def _(i):
    return G.top_results(i.search_results)


_NAMES = "(SELECT c_custkey + 1 AS business_id, concat('Acme ', CAST(c_custkey % 97 AS VARCHAR(10))) AS business_name FROM customer)"


def _names(i):
    return i.customer.select((F.col("c_custkey") + 1).alias("business_id"),
                             F.concat(F.lit("Acme "), (F.col("c_custkey") % 97).cast("string")).alias("business_name"))


@query("nest_results", f"""SELECT business_id, coalesce(urls, '') AS urls, coalesce(n, 0) AS n_items, coalesce(total, 0) AS total_results FROM {_NAMES} LEFT JOIN
  (SELECT business_id, string_agg(url, ' ' ORDER BY rk) AS urls, count(*) AS n, max(total_results) AS total FROM {TOP} GROUP BY 1) USING (business_id)""")
def _(i):
    r = F.col("envelope.data.result")
    return G.nest_results(_names(i), G.top_results(i.search_results)).select(
        "business_id", F.array_join(r["items"]["url"], " ").alias("urls"),
        F.size(r["items"]).cast("bigint").alias("n_items"), r["metadata"]["total_results"].alias("total_results"))


@query("flatten_results", f"""SELECT business_id, n.business_name, coalesce(total_results, 0) AS total_results, CAST(rk - 1 AS INTEGER) AS rank, pos, url, title, description, relevance_score
  FROM {_NAMES} n LEFT JOIN (SELECT * EXCLUDE (business_name) FROM {TOP}) USING (business_id)""")
def _(i):
    return G.flatten_results(G.nest_results(_names(i), G.top_results(i.search_results)))


PARTS_OK = f"""coalesce(street IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND zip_code IS NOT NULL AND {street_ok('street')} AND length(city) >= 2 AND regexp_matches(city, '^[\\pL\\s''.\\-]*$')
  AND state IN {VALID} AND regexp_matches(zip_code, '^\\d{{5}}(-\\d{{4}})?$'), false)"""


@query("resolve_results", f"""SELECT business_id, pos, name, outcome, CASE WHEN outcome = 'resolved' THEN street END AS address, CASE WHEN outcome = 'resolved' THEN state END AS state,
  CASE WHEN outcome = 'resolved' THEN zip_code END AS zip_code, CASE WHEN outcome = 'resolved' THEN 1.0::DOUBLE END AS confidence, url AS source_url FROM (
  SELECT *, CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'rejected' WHEN {PARTS_OK} AND upper(state) = 'NY' THEN CASE WHEN len(ne) = 0 THEN 'resolved' ELSE 'rejected' END ELSE 'needs_fetch' END AS outcome
  FROM (SELECT pos AS p0, business_id, business_name AS name, url, {NAME_ERRORS} AS ne FROM @search_results) r JOIN ({extract_sql("(SELECT pos, title || chr(10) || description AS body FROM @search_results)", 'pos', 'body', True)}) x ON r.p0 = x.pos)""")
def _(i):
    return G.resolve_results(i.search_results, target_state="NY")


@query("verify_page_results", f"""SELECT business_name, street AS address, city, state, zip_code, url AS source_url, relevance_score, true AS verified, 'webpage' AS source FROM (SELECT pos AS p0, business_name, url, 0.5::DOUBLE AS relevance_score FROM @search_results) r
  JOIN ({extract_sql("(SELECT pos, description FROM @search_results)", 'pos', 'description', True)}) x ON r.p0 = x.pos WHERE {PARTS_OK}""")
def _(i):
    return G.verify_page_results(i.search_results.withColumn("relevance_score", F.lit(0.5)), "description")


@query("match_result_name", """SELECT business_id, arg_min(url, pos) AS url, min(pos) AS pos FROM (SELECT *, list_filter(regexp_split_to_array(trim(lower(business_name)), '\\s+'), lambda w: contains(lower(title), w)) AS h FROM @search_results)
  WHERE len(h) > 0 AND url <> '' GROUP BY business_id""")
def _(i):
    return G.match_result_name(i.search_results)


@query("first_source", f"""SELECT n.business_id, n.business_name, coalesce(b.address, '') AS address FROM {_NAMES} n LEFT JOIN (SELECT business_id, arg_min(address, priority) AS address FROM (
    SELECT id AS business_id, address, 1 AS priority FROM @businesses WHERE verified UNION ALL SELECT id, address || ' (reviews)', 2 FROM @businesses WHERE state IS NOT NULL) WHERE trim(address) <> '' GROUP BY 1) b USING (business_id)""")
def _(i):
    b = i.businesses
    first = b.filter("verified").select(F.col("id").alias("business_id"), "address", F.lit(1).alias("priority"))
    second = b.filter("state IS NOT NULL").select(F.col("id").alias("business_id"), F.concat("address", F.lit(" (reviews)")).alias("address"), F.lit(2).alias("priority"))
    return G.first_source(_names(i), first.unionByName(second))


@query("fill_results", f"SELECT n.business_id AS row_id, n.business_name, coalesce(b.address, '') AS address FROM {_NAMES} n LEFT JOIN (SELECT id, address FROM @businesses WHERE verified) b ON b.id = n.business_id")
def _(i):
    found = i.businesses.filter("verified").select(F.col("id").alias("row_id"), "address")
    return G.fill_results(_names(i).withColumnRenamed("business_id", "row_id"), found)


@query("name_mentions", f"""SELECT page_id, business_name FROM @pages_biz JOIN (SELECT DISTINCT business_name FROM {_NAMES} UNION SELECT DISTINCT lower(c_mktsegment)[1:4] FROM customer) n ON contains(lower(html), lower(business_name))""")
def _(i):
    short = i.customer.select(F.substring(F.lower("c_mktsegment"), 1, 4).alias("business_name")).distinct()
    from tradebook.operators.mentions import name_mentions
    return name_mentions(i.pages_biz, "page_id", "html", _names(i).select("business_name").unionByName(short))


# --- model hooks, membership, end-to-end ----------------------------------------------------

@query("enhance_queries", """SELECT id, CASE WHEN id % 2 = 0 THEN trim(regexp_replace(business_name, '\\s+', ' ', 'g')) || ' office location' ELSE business_name || ' business address location New York NY official records contact information' END AS search_query,
  CASE WHEN id % 2 = 0 THEN 'model' ELSE 'fallback' END AS enhancement FROM @businesses""")
def _(i):
    def model(prompt):
        """A stand-in that reads the business out of its prompt."""
        named = F.regexp_extract(prompt, r"(?s)<business>(.*?)</business>", 1)
        return F.when(F.col("id") % 2 == 0, F.concat(F.lit(' "'), named, F.lit(' office location" '))).otherwise("?")
    return G.enhance_queries(i.businesses, model).select("id", "search_query", "enhancement")


@query("score_results", "SELECT pos, CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS relevance_score FROM (SELECT pos, (length(coalesce(title, '')) + 2 * length(coalesce(url, ''))) % 3 AS k FROM @search_results)")
def _(i):
    def model(prompt):
        """A stand-in whose answer depends on the title and the address in its prompt."""
        title = F.regexp_extract(prompt, r"(?s)Title: (.*?)\nDescription: ", 1)
        url = F.regexp_extract(prompt, r"\nURL: ([^\n]*)\n", 1)
        k = (F.length(title) + 2 * F.length(url)) % 3
        return F.when(k == 0, "good").when(k == 1, "7").otherwise(" 0.25 ")
    return G.score_results(i.search_results, model).select("pos", "relevance_score")


@query("members", "SELECT business_id, pos FROM @search_results WHERE business_id IN (SELECT id FROM @businesses WHERE verified)")
def _(i):
    return G.members(i.search_results.select("business_id", "pos"), "business_id", i.businesses.filter("verified").select("id"))


@query("non_members", "SELECT business_id, pos FROM @search_results WHERE business_id NOT IN (SELECT id FROM @businesses WHERE verified)")
def _(i):
    return G.members(i.search_results.select("business_id", "pos"), "business_id", i.businesses.filter("verified").select("id"), inside=False)


@query("businesses_from_results", f"""WITH top AS (SELECT * FROM {TOP}), hits AS (SELECT t.business_id AS id, t.business_name, x.street AS address, x.state, x.zip_code, row_number() OVER (PARTITION BY t.business_id ORDER BY t.relevance_score DESC, t.pos) AS first
    FROM top t JOIN ({extract_sql("(SELECT pos, title || chr(10) || description AS body FROM @search_results)", 'pos', 'body', True)}) x ON x.pos = t.pos WHERE {PARTS_OK.replace('street', 'x.street').replace('city', 'x.city').replace('zip_code', 'x.zip_code')} AND len({NAME_ERRORS.replace('business_name', 't.business_name')}) = 0)
  SELECT id, business_name, address, state, zip_code, '2024-01-31' AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY lower(business_name), lower(address) ORDER BY id) AS rn FROM hits WHERE first = 1) WHERE rn = 1""")
def _(i):
    from tradebook.plans.flows import businesses_from_results
    return businesses_from_results(i.search_results, "2024-01-31")
