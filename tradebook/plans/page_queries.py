"""Registered queries: extraction from fetched pages."""

from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.operators import pages as P
from tradebook.plans.ranking_queries import any_hit
from tradebook.plans.records_queries import extract_sql, format_sql
from tradebook.plans.registry import query

_FIELDS = "raw_address, street, city, state, zip_code, confidence, source"
_LD = """SELECT page_id, coalesce(json_extract_string(a, '$.streetAddress'), 'None') || ', ' || coalesce(json_extract_string(a, '$.addressLocality'), 'None') || ', ' || coalesce(json_extract_string(a, '$.addressRegion'), 'None') || ' ' || coalesce(json_extract_string(a, '$.postalCode'), 'None') AS raw_address,
  json_extract_string(a, '$.streetAddress') AS street, json_extract_string(a, '$.addressLocality') AS city, json_extract_string(a, '$.addressRegion') AS state, json_extract_string(a, '$.postalCode') AS zip_code, 0.9::DOUBLE AS confidence, 'structured_data' AS source
  FROM (SELECT page_id, json_extract(regexp_extract(html, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1), '$.address') AS a FROM @pages_biz WHERE contains(html, 'application/ld+json'))"""
_RAW_META = """(SELECT page_id, raw FROM (SELECT page_id, regexp_extract(html, '(?is)<meta\\s+property="og:street-address"\\s+content="([^"]*)"', 1) AS raw FROM @pages_biz) WHERE raw <> '')"""
_META = f"""SELECT r.page_id, r.raw AS raw_address, street, city, state, zip_code, 0.85::DOUBLE AS confidence, 'meta_tags' AS source FROM {_RAW_META} r JOIN ({extract_sql(_RAW_META, 'page_id', 'raw', True)}) x USING (page_id) WHERE street IS NOT NULL"""


@query("from_json_ld", _LD)
def _(i):
    return P.from_json_ld(i.pages_biz)


@query("from_meta_tags", _META)
def _(i):
    return P.from_meta_tags(i.pages_biz)


_TEXT = "replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(?:script|style)\\s*>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


def near_sql(pairs: str) -> str:
    """Check SQL: first address near the name for (page_id, business_name, html) pairs."""
    ctx = f"""(SELECT page_id, business_name, ln, page_id || '/' || business_name || '/' || ln AS pk, array_to_string(lines[greatest(ln - 2, 1):least(ln + 2, len(lines))], ' ') AS t FROM (
      SELECT page_id, business_name, lines, unnest(range(1, len(lines) + 1)) AS ln FROM (SELECT page_id, business_name, string_split({_TEXT}, chr(10)) AS lines FROM {pairs})) WHERE contains(lower(lines[ln]), lower(business_name)))"""
    return f"""SELECT page_id, business_name, t AS raw_address, street, city, state, zip_code, 0.75::DOUBLE AS confidence, 'text_content' AS source FROM (
      SELECT c.*, x.* EXCLUDE (pk), row_number() OVER (PARTITION BY page_id, business_name ORDER BY ln) AS rn FROM {ctx} c JOIN ({extract_sql(ctx, 'pk', 't', True)}) x ON x.pk = c.pk WHERE street IS NOT NULL) WHERE rn = 1"""


_NAMES = "(SELECT DISTINCT concat('Acme ', CAST(c_custkey % 97 AS VARCHAR(10))) AS business_name FROM customer)"


@query("from_text", near_sql(f"(SELECT page_id, html, business_name FROM @pages_biz JOIN {_NAMES} n ON contains(lower(html), lower(business_name)))"))
def _(i):
    names = i.customer.select(F.concat(F.lit("Acme "), (F.col("c_custkey") % 97).cast("string")).alias("business_name")).distinct()
    return P.from_text(i.pages_biz, names)


_OWN = "(SELECT *, concat('Acme ', CAST(page_id % 97 AS VARCHAR(10))) AS business_name FROM @pages_biz)"


def _own(i):
    return i.pages_biz.withColumn("business_name", F.concat(F.lit("Acme "), (F.col("page_id") % 97).cast("string")))


@query("extract_cascade", f"""SELECT page_id, business_name, {_FIELDS} FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC) AS rn FROM (
  SELECT o.business_name, l.* FROM ({_LD}) l JOIN {_OWN} o USING (page_id) UNION ALL BY NAME SELECT o.business_name, m.* FROM ({_META}) m JOIN {_OWN} o USING (page_id) UNION ALL BY NAME {near_sql(_OWN)})) WHERE rn = 1""")
def _(i):
    return P.extract_cascade(_own(i))


@query("extract_own_strategies", f"""SELECT page_id, business_name, {_FIELDS} FROM (SELECT o.business_name, m.* FROM ({_META}) m JOIN {_OWN} o USING (page_id) UNION ALL BY NAME SELECT * FROM ({near_sql(_OWN)}) WHERE page_id NOT IN (SELECT page_id FROM ({_META})))""")
def _(i):
    return P.extract_cascade(_own(i), [P.from_meta_tags, P.from_text])


@query("from_next_data", format_sql("""(SELECT page_id, array_to_string(list_filter([json_extract_string(a, '$.street'), json_extract_string(a, '$.city'), json_extract_string(a, '$.state'), json_extract_string(a, '$.zipCode'), json_extract_string(a, '$.country')], lambda x: coalesce(x, '') <> ''), ', ') AS raw FROM (
  SELECT page_id, json_extract(regexp_extract(html, '(?is)<script id="__NEXT_DATA__">(.*?)</script>', 1), '$.props.pageProps.business.location') AS a FROM @pages_biz WHERE contains(html, '__NEXT_DATA__')))""", "page_id", "raw", "address"))
def _(i):
    return P.from_next_data(i.pages_biz)


@query("flag_challenge_pages", f"SELECT page_id, {any_hit('lower(url)', fixed.CHALLENGE_URL_WORDS)} OR {any_hit('lower(html)', fixed.CHALLENGE_PHRASES)} OR regexp_matches(html, '(?i)class\\s*=\\s*\"[^\"]*cf-|id\\s*=\\s*\"(challenge-form|challenge-running|cf-please-wait|turnstile-wrapper|cf-content|cf_challenge-stage)\"|data-translate\\s*=\\s*\"challenge\"|<iframe[^>]*src\\s*=\\s*\"[^\"]*challenges') AS is_challenge FROM @pages_biz")
def _(i):
    return P.flag_challenge_pages(i.pages_biz).select("page_id", "is_challenge")


@query("flag_no_results", "SELECT page_id, regexp_matches(lower(h), 'no results found|we couldn''t find any results|try adjusting your search|0 results|nothing matches|no matches found') OR NOT regexp_matches(h, '(?i)class=\"([^\"]*\\s)?(search-results|business-listing|search-result|listing-item|result-item)(\\s[^\"]*)?\"|<a [^>]*class=\"([^\"]*\\s)?card(\\s[^\"]*)?\"') AS no_results FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(html, '<article>', '<article class=\"x result-item\">') WHEN page_id % 3 = 1 THEN replace(html, '<article>', '<a href=\"#\" class=\"card\">No Results Found</a>') ELSE html END AS h FROM @pages_biz)")
def _(i):
    k = F.col("page_id") % 3
    h = F.when(k == 0, F.replace("html", F.lit("<article>"), F.lit('<article class="x result-item">'))) \
        .when(k == 1, F.replace("html", F.lit("<article>"), F.lit('<a href="#" class="card">No Results Found</a>'))) \
        .otherwise(F.col("html"))
    return P.flag_no_results(i.pages_biz.withColumn("html", h)).select("page_id", "no_results")


@query("blocked_domains", f"""SELECT session_id, count(*) AS requests, count(*) FILTER (status IN (401, 403, 429)) AS refused FROM @http_log WHERE (contains(url, 'chamberofcommerce.com') OR contains(url, 'trustpilot.com'))
  AND session_id NOT IN (SELECT 's' || CAST(page_id AS VARCHAR(20)) FROM @pages_biz WHERE {any_hit('lower(html)', fixed.CONTENT_MARKERS)}) GROUP BY session_id HAVING count(*) FILTER (status IN (401, 403, 429)) > count(*) * 0.5""")
def _(i):
    content = i.pages_biz.select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("session_id"), "html")
    return P.blocked_domains(i.http_log, "session_id", content)


# Pages whose article carries a contact link, an address element and address attributes.
def _linked(i):
    k = F.col("page_id")
    body = F.concat(
        F.lit('<body><a href="/shop">x</a><a href="/contact-'), (k % 20).cast("string"), F.lit('">Contact</a>'),
        F.lit('<div class="contact-info">'), (k + 1).cast("string"), F.lit(" Elm St,<br> Troy, NY 12180</div>"),
        F.lit('<div data-address="'), (k + 7).cast("string"), F.lit(' Oak Ave, Albany, NY"><b>x</b></div>'))
    return i.pages.select("page_id", F.concat(F.lit("https://site.example.com/contact-"), k.cast("string")).alias("url"),
                          F.replace("html", F.lit("<body>"), body).alias("html"))


@query("from_contact_pages", """SELECT page_id, n || ' Elm St,Troy, NY 12180' AS raw_address, n || ' Elm St' AS street, 'Troy' AS city, 'NY' AS state, '12180' AS zip_code, 0.8::DOUBLE AS confidence, 'contact_page' AS source FROM (SELECT page_id, CAST(page_id % 20 + 1 AS VARCHAR(10)) AS n FROM pages)""")
def _(i):
    return P.from_contact_pages(_linked(i))


@query("from_selectors", "SELECT page_id, CAST(page_id + 7 AS VARCHAR(10)) || ' Oak Ave, Albany, NY' AS address FROM pages")
def _(i):
    return P.from_selectors(_linked(i))


@query("from_class_patterns", "SELECT page_id, 2::INTEGER AS pattern, CAST(page_id + 1 AS VARCHAR(10)) || ' Elm St, Troy, NY 12180' AS text FROM pages")
def _(i):
    return P.from_class_patterns(_linked(i))


@query("addresses_for_names", """SELECT c_custkey + 1 AS row_id, c_name AS business_name, CASE WHEN p.page_id IS NULL THEN '' WHEN p.page_id % 2 = 0 THEN p.page_id || ' Elm St, Troy' WHEN p.page_id % 3 = 0 THEN '7 Elm Rd, Troy, 12180' ELSE '[PARTIAL] Old Town Road' END AS address
  FROM customer LEFT JOIN pages p ON c_custkey = p.page_id""")
def _(i):
    from tradebook.plans.flows import addresses_for_names
    names = i.customer.select((F.col("c_custkey") + 1).alias("row_id"), F.col("c_name").alias("business_name"))
    k = F.col("page_id")
    base = i.pages.select("page_id", (k + 1).alias("row_id"), "url", "html")
    def inside(markup):
        """The page as it is, with the markup put first in its body."""
        return F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), markup))

    listing = base.withColumn("html", inside(F.when(k % 2 == 0, F.concat(
        F.lit('<div class="search-results"><address class="card-text">'), k.cast("string"), F.lit(" Elm St<br> Troy</address></div>")))
        .otherwise("<p>0 results</p>")))
    review = base.withColumn("html", inside(F.when(k % 3 == 0, F.lit('<script id="__NEXT_DATA__">{"props":{"pageProps":{"business":{"location":{"street":"7 Elm Rd","city":"Troy","zipCode":"12180"}}}}}</script>'))
                             .otherwise('<div class="location-info"><p>Old Town Road</p></div>')))
    return addresses_for_names(names, listing, review)
