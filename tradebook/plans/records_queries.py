"""Registered queries: cleaning, parsing, keys, predicates and validation of records."""

from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions import address as A
from tradebook.functions import checks as K
from tradebook.functions import text as X
from tradebook.functions.base import joined
from tradebook.operators import records as R
from tradebook.plans.registry import query

STATES = "(VALUES " + ", ".join(
    f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(fixed.STATE_NAMES)) + ") AS s(pos, name, code)"
CODES = "(" + ", ".join(f"'{c}'" for _, c in fixed.STATE_NAMES) + ")"
VALID = "(" + ", ".join(f"'{c}'" for c in fixed.VALID_STATES) + ")"
TYPES = "[" + ", ".join(f"'{c}'" for c in fixed.STREET_TYPES) + "]"
BAD = "(?i)" + "|".join(fixed.BAD_ADDRESS)


def norm_state(expr: str) -> str:
    """Check SQL of the state normalisation of a (non-blank) text."""
    s = f"upper(trim({expr}))"
    return (f"CASE WHEN coalesce({expr}, '') = '' THEN NULL WHEN {s} IN {CODES} THEN {s} ELSE coalesce("
            f"(SELECT min(code) FROM {STATES} WHERE name = {s}), "
            f"(SELECT arg_min(code, pos) FROM {STATES} WHERE starts_with(name, {s})), "
            f"CASE WHEN length({s}) = 2 THEN {s} END) END")


# --- cleaning -------------------------------------------------------------------------------

@query("clean_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned FROM documents")
def _(i):
    return i.documents.select("doc_id", X.clean_text("text").alias("cleaned"))


FORMAT_SQL = """CASE WHEN len(parts) = 0 THEN '' WHEN regexp_matches(one, '\\d') THEN one ELSE '[PARTIAL] ' || one END"""


def format_sql(source: str, key: str, col: str, out: str) -> str:
    return f"""SELECT {key}, {FORMAT_SQL} AS {out} FROM (
      SELECT {key}, parts, trim(regexp_replace(regexp_replace(array_to_string(parts, ', '), ',\\s*,', ',', 'g'), '\\s+', ' ', 'g'), ' ,') AS one FROM (
        SELECT {key}, list_filter(list_transform(string_split(regexp_replace(coalesce({col}, ''), '[\\w.\\-]+@[\\w.\\-]+\\.\\w+\\s*', '', 'g'), chr(10)), lambda p: trim(p, E' \\t\\r')), lambda p: p <> '') AS parts
        FROM {source}))"""


@query("format_address", format_sql("@businesses", "id", "address", "formatted"))
def _(i):
    return i.businesses.select("id", X.format_address("address").alias("formatted"))


@query("normalize_state", f"SELECT id, {norm_state('state')} AS code FROM @businesses")
def _(i):
    return i.businesses.select("id", A.normalize_state("state").alias("code"))


def state_zip_sql(b: bool, source: str) -> str:
    p = [x.replace("'", "''") for x in (
        (fixed.STATE_ZIP_END_B, fixed.STATE_END_B, fixed.ZIP_END_B) if b
        else (fixed.STATE_ZIP_END, fixed.STATE_END, fixed.ZIP_END))]
    def cut(x):
        return f"rtrim(trim(regexp_replace(a, '{x}', ''), E' \\n'), ',')"
    return f"""SELECT *, CASE WHEN k = 1 THEN {cut(p[0])} WHEN k = 2 THEN {cut(p[1])} WHEN k = 3 THEN {cut(p[2])} ELSE a END AS clean_address,
      CASE WHEN k = 1 THEN upper(regexp_extract(a, '{p[0]}', 1)) WHEN k = 2 THEN upper(regexp_extract(a, '{p[1]}', 1)) END AS found_state,
      CASE WHEN k = 1 THEN regexp_extract(a, '{p[0]}', 2) WHEN k = 3 THEN regexp_extract(a, '{p[2]}', 1) END AS found_zip
      FROM (SELECT *, CASE WHEN a IS NULL THEN 0 WHEN regexp_matches(a, '{p[0]}') THEN 1 WHEN regexp_matches(a, '{p[1]}') THEN 2 WHEN regexp_matches(a, '{p[2]}') THEN 3 ELSE 0 END AS k
            FROM (SELECT *, CASE WHEN coalesce(address, '') = '' THEN NULL ELSE trim(address) END AS a FROM {source}))"""


for _flag, _name in ((True, "parse_state_zip"), (False, "parse_state_zip_loose")):
    def _run(i, flag=_flag):
        p = A.parse_state_zip("address", flag)
        return i.businesses.select("id", p.alias("p")).select(
            "id", "p.clean_address", F.col("p.state").alias("found_state"),
            F.col("p.zip_code").alias("found_zip"))
    query(_name, f"SELECT id, clean_address, found_state, found_zip FROM ({state_zip_sql(_flag, '@businesses')})")(_run)


def clean_sql(keep: bool, b: bool = True) -> str:
    """Check SQL of the cleaned business records."""
    return f"""SELECT id, trim(business_name) AS business_name,
      CASE WHEN part AND coalesce(clean_address, '') <> '' THEN clean_address ELSE trim(address) END AS address,
      CASE WHEN NOT part THEN {norm_state('trim(state)')} WHEN coalesce(state, '') = '' THEN {norm_state('found_state')}
           {"ELSE " + norm_state('trim(state)') if keep else ""} END AS state,
      CASE WHEN NOT part THEN trim(zip_code) WHEN coalesce(zip_code, '') = '' THEN found_zip {"ELSE trim(zip_code)" if keep else ""} END AS zip_code,
      created_at, verified, violation_type
      FROM (SELECT *, coalesce(state, '') = '' OR coalesce(zip_code, '') = '' AS part FROM ({state_zip_sql(b, '@businesses')})
            WHERE id <> 0 AND coalesce(business_name, '') <> '' AND coalesce(address, '') <> '' AND coalesce(created_at, '') <> '')"""


@query("clean_business", clean_sql(True))
def _(i):
    return R.clean_business(i.businesses)


@query("clean_business_drop_given", clean_sql(False, False))
def _(i):
    return R.clean_business(i.businesses, keep_given=False, word_boundary=False)


@query("coerce_record", """SELECT TRY_CAST(id AS BIGINT) AS id, trim(business_name) AS business_name, trim(address) AS address,
  CASE WHEN coalesce(state, '') <> '' THEN upper(trim(state)) END AS state, CASE WHEN coalesce(zip_code, '') <> '' THEN trim(zip_code) END AS zip_code,
  trim(created_at) AS created_at FROM @businesses""")
def _(i):
    return R.coerce_record(R.with_missing_columns(i.businesses.withColumn("id", F.col("id").cast("string"))))


@query("parse_date", """SELECT id, strftime(coalesce(try_strptime(trim(created_at), '%Y-%m-%d'), try_strptime(trim(created_at), '%m/%d/%Y'),
  try_strptime(trim(created_at), '%d-%m-%Y'), try_strptime(trim(created_at), '%Y/%m/%d')), '%Y-%m-%d') AS created FROM @businesses""")
def _(i):
    return i.businesses.select("id", X.parse_date("created_at").alias("created"))


@query("strip_specials", """SELECT id, trim(regexp_replace(regexp_replace(business_name, '[^\\w\\s.,\\-]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM @businesses""")
def _(i):
    return i.businesses.select("id", X.strip_specials("business_name").alias("cleaned"))


@query("zip5", "SELECT id, CASE WHEN regexp_matches(coalesce(zip_code, ''), '^\\d{5}(-\\d{4})?$') THEN zip_code[1:5] ELSE '' END AS zip FROM @businesses")
def _(i):
    return i.businesses.select("id", X.zip5("zip_code").alias("zip"))


@query("strict_state", "SELECT id, CASE WHEN regexp_matches(coalesce(state, ''), '^[A-Z]{2}$') THEN state ELSE '' END AS code FROM @businesses")
def _(i):
    return i.businesses.select("id", X.strict_state("state").alias("code"))


SPLIT_SQL = f"""SELECT id, street, city, state, zip_code FROM (
  SELECT id, p[1] AS street, zip AS zip_code, CASE WHEN hit THEN upper(r[len(r)]) END AS state,
    coalesce(CASE WHEN enough THEN nullif(array_to_string(CASE WHEN hit THEN r[1:len(r)-1] ELSE r END, ' '), '') END, CASE WHEN len(p) >= 3 THEN p[2] END) AS city
  FROM (SELECT *, enough AND upper(r[len(r)]) IN {VALID} AS hit FROM (
    SELECT *, CASE WHEN zip IS NOT NULL THEN w[1:len(w)-1] ELSE w END AS r FROM (
      SELECT *, CASE WHEN enough AND regexp_matches(w[len(w)], '^\\d{{5}}(-\\d{{4}})?$') THEN w[len(w)] END AS zip FROM (
        SELECT *, len(p) >= 2 AND len(w) >= 2 AS enough FROM (
          SELECT id, p, regexp_split_to_array(p[len(p)], '\\s+') AS w FROM (
            SELECT id, list_transform(string_split(address, ','), lambda x: trim(x, E' \\n')) AS p FROM @businesses))))))) """


@query("split_address", SPLIT_SQL)
def _(i):
    return i.businesses.select("id", A.split_address("address").alias("p")).select("id", "p.*")


def extract_sql(source: str, key: str, col: str, b: bool) -> str:
    z, s = (fixed.ADDRESS_ZIP_B, fixed.ADDRESS_STATE_B) if b else (fixed.ADDRESS_ZIP, fixed.ADDRESS_STATE)
    c = fixed.ADDRESS_CITY
    def g(p, n):
        return f"trim(regexp_extract({col}, '{p}', {n}), E' \\n\\t\\r')"
    def pick(n):
        both = f"WHEN k = 2 THEN {g(s, n)}" if n <= 3 else ""
        city = f"WHEN k = 3 THEN {g(c, n)}" if n <= 2 else ""
        return f"CASE WHEN k = 1 THEN {g(z, n)} {both} {city} END"
    return f"""SELECT {key}, {pick(1)} AS street, {pick(2)} AS city, {pick(3)} AS state, {pick(4)} AS zip_code FROM (
      SELECT *, CASE WHEN regexp_matches({col}, '{z}') THEN 1 WHEN regexp_matches({col}, '{s}') THEN 2 WHEN regexp_matches({col}, '{c}') THEN 3 ELSE 0 END AS k FROM {source})"""


for _flag, _name in ((True, "extract_address"), (False, "extract_address_loose")):
    def _run(i, flag=_flag):
        return i.businesses.select("id", A.extract_address("address", flag).alias("p")).select("id", "p.*")
    query(_name, extract_sql("@businesses", "id", "address", _flag))(_run)

KEY_SQL = "trim(lower(coalesce(business_name, ''))) || '|' || trim(lower(coalesce(address, '')))"


@query("business_key", f"SELECT id, {KEY_SQL} AS business_key FROM @businesses")
def _(i):
    return i.businesses.select("id", X.business_key("business_name", "address").alias("business_key"))


@query("params_key", """SELECT id, md5('search|' || business_name || '|limit=10|state=' || coalesce(state, 'None')) AS params_key FROM @businesses""")
def _(i):
    return i.businesses.select("id", X.params_key(
        F.array(F.lit("search"), F.col("business_name")),
        F.create_map(F.lit("state"), F.coalesce("state", F.lit("None")), F.lit("limit"), F.lit("10"))
    ).alias("params_key"))


DOMAIN_SQL = "regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


@query("url_domain", f"SELECT page_id, {DOMAIN_SQL} AS domain FROM pages")
def _(i):
    return i.pages.select("page_id", X.url_domain("url").alias("domain"))


@query("search_url", """SELECT id, 'https://www.chamberofcommerce.com/search?what=' || replace(business_name, ' ', '+') || '&where=' AS chamber_url,
  'https://www.trustpilot.com/search?query=' || replace(business_name, ' ', '%20') AS reviews_url FROM @businesses""")
def _(i):
    return i.businesses.select("id", X.search_url("business_name", "chamber").alias("chamber_url"),
                               X.search_url("business_name", "reviews").alias("reviews_url"))


@query("format_business", f"""SELECT business_name AS name, coalesce(street, '') AS address, coalesce(city, '') AS city, coalesce(state, '') AS state,
  coalesce(zip_code, '') AS zip_code, 0.9 ::DOUBLE AS confidence, source_url, 'search_result' AS source, '2024-01-31T00:00:00' AS extracted_at,
  regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1) AS domain
  FROM ({SPLIT_SQL}) JOIN (SELECT id, business_name, 'https://' || violation_type || '.example.com:443/b?id=' || id AS source_url FROM @businesses) USING (id)""")
def _(i):
    src = i.businesses.select(
        F.col("business_name").alias("name"), A.split_address("address").alias("p"),
        F.concat(F.lit("https://"), F.col("violation_type"), F.lit(".example.com:443/b?id="),
                 F.col("id").cast("string")).alias("source_url")).select(
        "name", "p.*", F.lit(0.9).alias("confidence"), "source_url")
    return R.format_business(src, "2024-01-31T00:00:00").select("*", "metadata.*").drop("metadata")


@query("record_json", """SELECT id, '{' || array_to_string(list_filter(['"id":' || id, '"business_name":' || to_json(business_name), '"address":' || to_json(address),
  '"state":' || to_json(state), '"zip_code":' || to_json(zip_code), '"created_at":' || to_json(created_at)], lambda x: x IS NOT NULL), ',') || '}' AS json FROM @businesses""")
def _(i):
    return i.businesses.select("id", R.record_json(i.businesses).alias("json"))


@query("record_label", """SELECT id, 'Business(id=' || id || ', name=''' || business_name || ''', address=''' || address || ''', state=''' ||
  CASE WHEN coalesce(state, '') = '' THEN 'N/A' ELSE state END || ''', zip=''' || CASE WHEN coalesce(zip_code, '') = '' THEN 'N/A' ELSE zip_code END ||
  ''', created=''' || created_at || ''')' AS label FROM @businesses""")
def _(i):
    return R.with_label(i.businesses).select("id", "label")


@query("fallback_query", """SELECT id, business_name || ' business address location New York NY official records contact information' AS query FROM @businesses""")
def _(i):
    return i.businesses.select("id", X.fallback_query("business_name").alias("query"))


@query("build_prompt", "SELECT id, replace('" + fixed.QUERY_PROMPT + "', '%s', business_name) AS prompt FROM @businesses")
def _(i):
    return i.businesses.select("id", X.build_prompt("business_name").alias("prompt"))


_SP = fixed.SCORE_PROMPT.split("%s")


@query("build_score_prompt", f"SELECT pos, '{_SP[0]}' || title || '{_SP[1]}' || description || '{_SP[2]}' || url || '{_SP[3]}' AS prompt FROM @search_results")
def _(i):
    return i.search_results.select("pos", X.build_score_prompt("title", "description", "url").alias("prompt"))


@query("parse_model_query", """SELECT doc_id, CASE WHEN length(q) >= 5 AND regexp_matches(lower(q), 'business|company|address|location') THEN q END AS query FROM (
  SELECT doc_id, CASE WHEN s = '"' THEN '' WHEN starts_with(s, '"') AND ends_with(s, '"') THEN trim(s[2:length(s)-1]) ELSE s END AS q FROM (
    SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '" ' || text || ' business"' ELSE text END, '\\s+', ' ', 'g')) AS s FROM documents))""")
def _(i):
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('" '), F.col("text"), F.lit(' business"'))) \
        .otherwise(F.col("text"))
    return i.documents.select("doc_id", X.parse_model_query(answer).alias("query"))


@query("parse_model_score", """SELECT l_orderkey, l_linenumber, least(greatest(coalesce(TRY_CAST(raw AS DOUBLE), 0.5), 0.0), 1.0) AS score FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'score: ' || l_discount WHEN l_returnflag = 'A' THEN ' -' || l_tax ELSE ' ' || (l_discount * l_quantity) || ' ' END AS raw FROM lineitem)""")
def _(i):
    raw = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("score: "), F.col("l_discount").cast("string"))) \
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(" -"), F.col("l_tax").cast("string"))) \
        .otherwise(F.concat(F.lit(" "), (F.col("l_discount") * F.col("l_quantity")).cast("string"), F.lit(" ")))
    return i.lineitem.select("l_orderkey", "l_linenumber", X.parse_model_score(raw).alias("score"))


@query("event_priority", """SELECT event_id, CASE WHEN type = 'ERROR' THEN 'HIGH' WHEN type = 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE severity WHEN 'error' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' ELSE 'LOW' END AS severity_priority FROM @op_events""")
def _(i):
    return i.op_events.select("event_id", X.event_priority("type").alias("priority"),
                              X.severity_priority("severity").alias("severity_priority"))


@query("metric_name", """SELECT event_id, CASE event_type WHEN 'error' THEN 'db_size.total' WHEN 'view' THEN 'cache_hits' WHEN 'click' THEN 'custom.rate' WHEN 'signup' THEN 'sys_cpu' ELSE 'plain' END AS metric,
  'error_' || lower(event_type) AS error_metric FROM events""")
def _(i):
    raw = F.when(F.col("event_type") == "error", "database.size.total").when(F.col("event_type") == "view", "cache.hits") \
        .when(F.col("event_type") == "click", "custom.rate").when(F.col("event_type") == "signup", "system.cpu") \
        .otherwise("plain")
    return i.events.select("event_id", X.metric_name(raw).alias("metric"),
                           X.error_metric_name(F.upper("event_type")).alias("error_metric"))


@query("is_sensitive_key", "SELECT doc_id, regexp_matches(lower(text), 'password|secret|token|key|auth|credential|private') AS sensitive FROM documents")
def _(i):
    return i.documents.select("doc_id", X.is_sensitive_key("text").alias("sensitive"))


@query("active_tokens", "SELECT token[1:8] || '...' AS token, username, expires_at FROM @tokens WHERE expires_at > 500")
def _(i):
    from tradebook.operators.keyed import active_tokens
    return active_tokens(i.tokens, 500)


@query("alert_text", """SELECT event_id, '[' || upper(severity) || '] high_latency: High system latency detected: Average latency is ' || printf('%.2f', latency_ms) || 'ms' AS line FROM @op_events""")
def _(i):
    msg = F.format_string("High system latency detected: Average latency is %.2fms", F.col("latency_ms"))
    return i.op_events.select("event_id", X.alert_text("severity", F.lit("high_latency"), msg).alias("line"))


@query("format_timestamps", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at, o_orderstatus FROM orders""")
def _(i):
    from tradebook.operators.dashboard import format_timestamps
    return format_timestamps(i.orders.select("o_orderkey", F.col("o_orderdate").alias("created_at"),
                                             F.col("o_orderdate").alias("updated_at"), "o_orderstatus"))


# --- predicates and validation --------------------------------------------------------------

@query("is_valid_state_zip", f"""SELECT id, coalesce(upper(state) IN {VALID}, false) AS state_ok, coalesce(regexp_matches(zip_code, '^\\d{{5}}(-\\d{{4}})?$'), false) AS zip_ok FROM @businesses""")
def _(i):
    return i.businesses.select("id", A.is_valid_state("state").alias("state_ok"),
                               A.is_valid_zip("zip_code").alias("zip_ok"))


@query("is_valid_url", "SELECT pos, regexp_matches(url, '^https?://[^/?#]+') AS url_ok FROM @search_results")
def _(i):
    return i.search_results.select("pos", K.is_valid_url("url").alias("url_ok"))


URL_ERRORS = """CASE WHEN coalesce(url, '') = '' THEN ['URL cannot be empty'] WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+') THEN ['Invalid URL format']
  WHEN NOT regexp_matches(url, '(?i)^https?://') THEN ['URL must use HTTP or HTTPS protocol'] ELSE [] END"""


@query("validate_url", f"""SELECT pos, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error, CASE WHEN len(e) = 0 AND length(url) > 2048 THEN 'URL is unusually long' ELSE '' END AS warning
  FROM (SELECT pos, url, {URL_ERRORS} AS e FROM (SELECT pos, CASE WHEN pos % 10 = 7 THEN url || repeat('x', 2100) ELSE url END AS url FROM @search_results))""")
def _(i):
    url = F.when(F.col("pos") % 10 == 7, F.concat("url", F.repeat(F.lit("x"), 2100))).otherwise(F.col("url"))
    return i.search_results.select("pos", K.validate_url(url).alias("v")).select(
        "pos", "v.is_valid", joined(F.col("v.errors")).alias("error"),
        F.array_join("v.warnings", "; ").alias("warning"))


STREET_OK = f"""(len(regexp_split_to_array(trim(lower({{c}})), '\\s+')) >= 2 AND regexp_matches(trim({{c}}), '^\\d') AND
  list_has_any(regexp_split_to_array(trim(lower({{c}})), '\\s+'), {TYPES}))"""


def street_ok(c: str) -> str:
    return STREET_OK.replace("{c}", c)


@query("is_valid_street", f"SELECT id, {street_ok('street')} AS street_ok FROM (SELECT id, split_part(address, ',', 1) AS street FROM @businesses)")
def _(i):
    return i.businesses.select("id", A.is_valid_street(F.split_part("address", F.lit(","), F.lit(1))).alias("street_ok"))


def component_sql(inner: str) -> str:
    """Check SQL: error list of (street, city, state, zip_code)."""
    return f"""list_filter([
      CASE WHEN coalesce(street, '') = '' THEN 'Missing street' WHEN NOT {street_ok('street')} THEN 'Invalid street format' END,
      CASE WHEN coalesce(city, '') = '' THEN 'Missing city' WHEN length(city) < 2 THEN 'City name too short' WHEN NOT regexp_matches(city, '^[\\pL\\s''.\\-]*$') THEN 'City contains invalid characters' END,
      CASE WHEN coalesce(state, '') = '' THEN 'Missing state' WHEN state NOT IN {VALID} THEN 'Invalid state code' END,
      CASE WHEN coalesce(zip_code, '') = '' THEN 'Missing ZIP code' WHEN NOT regexp_matches(zip_code, '^\\d{{5}}(-\\d{{4}})?$') THEN 'Invalid ZIP code format' END], lambda x: x IS NOT NULL)"""


ADDRESS_ERRORS = f"""(SELECT b.id, b.address, CASE WHEN b.address IS NULL OR regexp_matches(b.address, '{BAD}') THEN ['Invalid address format'] WHEN length(b.address) < 5 THEN ['Address too short']
  WHEN NOT regexp_matches(b.address, '\\d') THEN ['Address must contain at least one number'] ELSE comp END AS e
  FROM @businesses b JOIN (SELECT id, {component_sql('')} AS comp FROM ({SPLIT_SQL})) s ON b.id = s.id)"""


@query("validate_address_text", f"SELECT id, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error, CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM {ADDRESS_ERRORS}")
def _(i):
    return i.businesses.select("id", A.validate_address_text("address").alias("v")).select(
        "id", "v.is_valid", joined(F.col("v.errors")).alias("error"), "v.confidence")


@query("validate_components", f"SELECT id, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error FROM (SELECT id, {component_sql('')} AS e FROM ({SPLIT_SQL}))")
def _(i):
    return i.businesses.select("id", A.validate_components(A.split_address("address")).alias("v")).select(
        "id", "v.is_valid", joined(F.col("v.errors")).alias("error"))


@query("validate_address_parts", f"""SELECT id, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error FROM (
  SELECT id, CASE WHEN street IS NULL THEN ['Missing required field: street'] WHEN city IS NULL THEN ['Missing required field: city'] WHEN state IS NULL THEN ['Missing required field: state']
    WHEN zip_code IS NULL THEN ['Missing required field: zip_code'] ELSE list_filter([CASE WHEN NOT {street_ok('street')} THEN 'Invalid street format' END,
      CASE WHEN length(city) < 2 THEN 'City name too short' WHEN NOT regexp_matches(city, '^[\\pL\\s''.\\-]*$') THEN 'City contains invalid characters' END,
      CASE WHEN state NOT IN {VALID} THEN 'Invalid state code' END, CASE WHEN NOT regexp_matches(zip_code, '^\\d{{5}}(-\\d{{4}})?$') THEN 'Invalid ZIP code format' END], lambda x: x IS NOT NULL) END AS e
  FROM (SELECT id, split_part(address, ',', 1) AS street, violation_type AS city, state, zip_code FROM @businesses))""")
def _(i):
    return i.businesses.select("id", A.validate_address_parts(
        F.split_part("address", F.lit(","), F.lit(1)), "violation_type", "state", "zip_code").alias("v")).select(
        "id", "v.is_valid", joined(F.col("v.errors")).alias("error"))


@query("match_state", f"""SELECT id, m IS NULL AS is_valid, m AS message FROM (SELECT id, CASE WHEN coalesce(state, '') = '' THEN 'State is required' WHEN upper(state) NOT IN {VALID} THEN 'Invalid state code: ' || upper(state)
  WHEN upper(state) <> 'CA' THEN 'State ' || upper(state) || ' does not match target state CA' END AS m FROM @businesses)""")
def _(i):
    return i.businesses.select("id", A.match_state("state", "ca").alias("m")).select("id", "m.*")


_BL = "[" + ", ".join(f"'{w}'" for w in fixed.NAME_BLACKLIST) + "]"
NAME_ERRORS = f"""CASE WHEN length(coalesce(business_name, '')) < 2 THEN ['Business name too short']
  WHEN len(list_filter({_BL}, lambda w: contains(lower(business_name), w))) > 0 THEN ['Business name contains invalid term: ' || list_filter({_BL}, lambda w: contains(lower(business_name), w))[1]]
  WHEN length(regexp_replace(business_name, '[\\pL\\pN\\s]', '', 'g')) > length(business_name) * 0.3 THEN ['Business name contains too many special characters'] ELSE [] END"""
NAME_WARN = """list_filter([CASE WHEN list_contains(regexp_split_to_array(trim(lower(business_name)), '\\s+'), 'inc') AND NOT regexp_matches(business_name, '(Inc\\.|Inc|Incorporated)$') THEN 'Inconsistent Inc. formatting' END,
  CASE WHEN list_contains(regexp_split_to_array(trim(lower(business_name)), '\\s+'), 'llc') AND NOT regexp_matches(business_name, '(LLC|L\\.L\\.C\\.)$') THEN 'Inconsistent LLC formatting' END], lambda x: x IS NOT NULL)"""


@query("validate_name", f"SELECT id, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error, CASE WHEN len(e) = 0 THEN array_to_string(w, '; ') ELSE '' END AS warning FROM (SELECT id, {NAME_ERRORS} AS e, {NAME_WARN} AS w FROM @businesses)")
def _(i):
    return i.businesses.select("id", K.validate_name("business_name").alias("v")).select(
        "id", "v.is_valid", joined(F.col("v.errors")).alias("error"),
        F.array_join("v.warnings", "; ").alias("warning"))


def business_sql(propagate: bool) -> str:
    """Check SQL of the business verdict: id, e (errors), w (warnings)."""
    addr = "a.e" if propagate else "[]::VARCHAR[]"
    return f"""SELECT b.id, b.business_name, CASE WHEN len(ne) > 0 THEN ne ELSE list_concat({addr}, CASE WHEN created_at <> '' AND try_strptime(created_at, '%Y-%m-%d') IS NULL THEN ['Invalid created_at date format'] ELSE [] END) END AS e,
      CASE WHEN len(ne) > 0 THEN [] ELSE w END AS w
      FROM (SELECT *, {NAME_ERRORS} AS ne, {NAME_WARN} AS w FROM @businesses) b JOIN {ADDRESS_ERRORS} a ON a.id = b.id"""


for _flag, _name in ((True, "validate_business"), (False, "validate_business_name_only")):
    def _run(i, flag=_flag):
        return i.businesses.select("id", K.validate_business(
            "business_name", "address", created_at="created_at", propagate_address_errors=flag).alias("v")).select(
            "id", "v.is_valid", joined(F.col("v.errors")).alias("error"),
            F.array_join("v.warnings", "; ").alias("warning"), "v.confidence")
    query(_name, f"SELECT id, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error, array_to_string(w, '; ') AS warning, CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM ({business_sql(_flag)})")(_run)


@query("validate_search_result", f"""SELECT pos, len(e) = 0 AS is_valid, nullif(array_to_string(e, '; '), '') AS error FROM (SELECT pos, list_concat({URL_ERRORS},
  list_filter([CASE WHEN length(title) < 3 THEN 'Title too short' END, CASE WHEN pos % 6 = 1 THEN 'Invalid relevance score type' WHEN pos % 6 = 2 THEN 'Relevance score must be between 0 and 1' END], lambda x: x IS NOT NULL)) AS e FROM @search_results)""")
def _(i):
    score = F.when(F.col("pos") % 6 == 0, "0.5").when(F.col("pos") % 6 == 1, "high").when(F.col("pos") % 6 == 2, "1.5")
    return i.search_results.select("pos", K.validate_search_result("url", "title", score).alias("v")).select(
        "pos", "v.is_valid", joined(F.col("v.errors")).alias("error"))


@query("check_record_constraints", """SELECT id, nullif(array_to_string(e, '; '), '') AS errors, e[1] AS first_error FROM (SELECT id, list_filter([
  CASE WHEN id <= 0 THEN 'id must be a positive integer' END,
  CASE WHEN length(trim(business_name)) NOT BETWEEN 2 AND 200 THEN 'business_name length must be between 2 and 200 characters' END,
  CASE WHEN length(trim(address)) NOT BETWEEN 5 AND 200 THEN 'address length must be between 5 and 200 characters' END,
  CASE WHEN state IS NOT NULL AND NOT regexp_matches(state, '^\\pL{2}$') THEN 'state must be a two-letter code' END,
  CASE WHEN zip_code IS NOT NULL AND NOT regexp_matches(zip_code, '^\\d{5}(-\\d{4})?$') THEN 'zip_code must be in format XXXXX or XXXXX-XXXX' END,
  CASE WHEN try_strptime(created_at, '%Y-%m-%d') IS NULL THEN 'created_at must be in format %Y-%m-%d' WHEN try_strptime(created_at, '%Y-%m-%d') > TIMESTAMP '2024-01-20' THEN 'created_at cannot be in the future' END], lambda x: x IS NOT NULL) AS e FROM @businesses)""")
def _(i):
    e = K.record_constraints("id", "business_name", "address", "state", "zip_code", "created_at", "2024-01-20")
    return i.businesses.select("id", e.alias("e")).select(
        "id", joined(F.col("e")).alias("errors"), K.first_violation(F.col("e")).alias("first_error"))


@query("in_allowed_domains", f"""SELECT pos, regexp_matches(regexp_replace(lower({DOMAIN_SQL}), ':\\d+$', ''), '(^|\\.)({"|".join(d.replace(".", chr(92) + ".") for d in fixed.ALLOWED_DOMAINS)})$') AS allowed FROM @search_results""")
def _(i):
    return i.search_results.select("pos", K.in_allowed_domains("url").alias("allowed"))


@query("validate_contact_field", f"""SELECT c_custkey, regexp_matches(phone, '^\\+?1?\\d{{9,15}}$') AS phone_ok, regexp_matches(email, '{fixed.EMAIL}') AS email_ok, regexp_matches(url, '{fixed.WEB_URL}') AS url_ok FROM (
  SELECT c_custkey, '+1' || repeat(CAST(c_custkey % 10 AS VARCHAR(5)), CAST(c_custkey % 18 AS INTEGER)) AS phone, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '@x.org' ELSE c_name || '@' END AS email,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://www.' || c_name || '.com/a?b=1' ELSE 'ftp://' || c_name END AS url FROM customer)""")
def _(i):
    k = F.col("c_custkey")
    return i.customer.select(
        "c_custkey",
        K.validate_contact_field(F.concat(F.lit("+1"), F.repeat((k % 10).cast("string"), (k % 18).cast("int"))), "phone").alias("phone_ok"),
        K.validate_contact_field(F.when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("@x.org"))).otherwise(F.concat("c_name", F.lit("@"))), "email").alias("email_ok"),
        K.validate_contact_field(F.when(k % 4 == 0, F.concat(F.lit("https://www."), F.col("c_name"), F.lit(".com/a?b=1"))).otherwise(F.concat(F.lit("ftp://"), F.col("c_name"))), "url").alias("url_ok"))


@query("missing_fields", """SELECT id, array_to_string(list_filter([CASE WHEN coalesce(business_name, '') = '' THEN 'business_name' END, CASE WHEN coalesce(address, '') = '' THEN 'address' END,
  CASE WHEN coalesce(state, '') = '' THEN 'state' END, CASE WHEN coalesce(zip_code, '') = '' THEN 'zip_code' END], lambda x: x IS NOT NULL), ',') AS missing FROM @businesses""")
def _(i):
    return i.businesses.select("id", F.array_join(K.missing_fields(
        ["business_name", "address", "state", "zip_code"]), ",").alias("missing"))


_KW = "[" + ", ".join(f"'{w}'" for w in fixed.NAME_KEYWORDS) + "]"


@query("keyword_hits", f"SELECT id, array_to_string(list_sort(list_distinct(list_intersect(regexp_split_to_array(trim(lower(business_name)), '\\s+'), {_KW}))), ',') AS hits FROM @businesses")
def _(i):
    return i.businesses.select("id", F.array_join(K.keyword_hits("business_name"), ",").alias("hits"))


# --- duplicates and unions ------------------------------------------------------------------

FIRSTS = f"(SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY id) AS rn FROM @businesses)"


@query("dedup_businesses", f"SELECT * EXCLUDE (rn) FROM {FIRSTS} WHERE rn = 1")
def _(i):
    return R.dedup_businesses(i.businesses)


@query("mark_duplicates", "SELECT id, business_name, row_number() OVER (PARTITION BY business_name ORDER BY id) > 1 AS is_duplicate FROM @businesses")
def _(i):
    return R.mark_duplicates(i.businesses.select("id", "business_name"), "business_name")


@query("duplicate_summary", "SELECT id, business_name, count(*) OVER () AS total_duplicates FROM (SELECT id, business_name, row_number() OVER (PARTITION BY business_name ORDER BY id) AS rn FROM @businesses) WHERE rn > 1")
def _(i):
    return R.duplicate_summary(i.businesses, "business_name")


@query("union_chunks", "SELECT id, business_name, address, state, zip_code, created_at FROM @businesses UNION ALL SELECT id, business_name, address, NULL, NULL, created_at FROM @businesses WHERE verified")
def _(i):
    b = i.businesses
    return R.union_chunks([b, b.filter("verified").select("created_at", "address", "business_name", "id")])


@query("collect_query_results", "SELECT pos, url, title, CAST(NULL AS DOUBLE) AS relevance_score FROM @search_results UNION ALL SELECT pos, url, title, 0.5::DOUBLE FROM @search_results WHERE pos % 2 = 0")
def _(i):
    r = i.search_results.select("pos", "url", "title")
    return R.collect_query_results([r, r.filter("pos % 2 = 0").withColumn("relevance_score", F.lit(0.5))])


@query("found_count", "SELECT count(*) FILTER (coalesce(address, '') <> '') AS addresses_found, count(*) AS rows FROM @businesses")
def _(i):
    return R.found_count(i.businesses)


@query("count_by_state", f"""SELECT state, count(*) AS count FROM (SELECT c.*, row_number() OVER (PARTITION BY {KEY_SQL.replace('business_name', 'c.business_name').replace('address', 'c.address')} ORDER BY id) AS rn
  FROM ({clean_sql(True)}) c JOIN (SELECT id FROM ({business_sql(False)}) WHERE len(e) = 0) v USING (id)) WHERE rn = 1 GROUP BY state""")
def _(i):
    from tradebook.operators.dashboard import count_by
    cleaned = R.clean_business(i.businesses.filter(K.validate_business(
        "business_name", "address", created_at="created_at", propagate_address_errors=False)["is_valid"]))
    return count_by(R.dedup_businesses(cleaned), "state")
