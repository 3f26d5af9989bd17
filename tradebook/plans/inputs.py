"""Inputs of the registered queries: the given tables and views derived from them.

Each derived view is one SQL text understood by Spark and by the checking engine alike. Tables
and views are written ``@name`` and filled in with DataFrames (Spark) or by name (checks).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


VIEWS: dict[str, str] = {}

VIEWS["businesses"] = """
SELECT c_custkey + 1 AS id,
  CASE WHEN c_custkey % 13 = 0 THEN concat('Test ', c_name)
       WHEN c_custkey % 13 = 1 THEN concat('  ', c_name, ' LLC  ')
       WHEN c_custkey % 13 = 2 THEN concat(c_name, ' inc co')
       WHEN c_custkey % 13 = 3 THEN '!'
       WHEN c_custkey % 13 = 4 THEN '@@##$$ ab'
       ELSE concat('Acme ', CAST(c_custkey % 97 AS VARCHAR(10))) END AS business_name,
  CASE WHEN c_custkey % 17 = 0 THEN 'P.O. Box 12'
       WHEN c_custkey % 17 = 1 THEN ''
       WHEN c_custkey % 17 = 2 THEN concat('info@shop.com ', a.num, ' Main Street', chr(10), n_name, chr(10), a.zip)
       WHEN c_custkey % 17 = 3 THEN concat(a.num, ' Oak Ave, Troy NY')
       WHEN c_custkey % 17 = 4 THEN concat(a.num, ' Oak Ave, Troy ', a.zip)
       WHEN c_custkey % 17 = 5 THEN concat(a.num, ' N Elm, Suite 4, Albany, ca ', a.zip, '-1234')
       WHEN c_custkey % 17 = 6 THEN n_name
       ELSE concat(a.num, ' ', n_name, ' St, Albany, NY ', a.zip) END AS address,
  CASE WHEN c_custkey % 5 = 0 THEN 'new york' WHEN c_custkey % 5 = 1 THEN 'CA' WHEN c_custkey % 5 = 2 THEN 'Te'
       WHEN c_custkey % 5 = 3 THEN 'Ontario' END AS state,
  CASE WHEN c_custkey % 3 = 0 THEN a.zip WHEN c_custkey % 3 = 1 THEN '123' END AS zip_code,
  CASE WHEN c_custkey % 19 = 0 THEN '01/15/2024' WHEN c_custkey % 19 = 1 THEN 'n/a'
       ELSE concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS VARCHAR(10)), 2, '0')) END AS created_at,
  c_custkey % 4 = 0 AS verified, c_mktsegment AS violation_type
FROM (SELECT *, CAST(100 + c_custkey % 900 AS VARCHAR(10)) AS num,
             lpad(CAST(10000 + c_custkey % 50 AS VARCHAR(10)), 5, '0') AS zip FROM @customer) a
JOIN @nation ON c_nationkey = n_nationkey
"""

VIEWS["pages_biz"] = """
SELECT page_id, url,
  replace(replace(html, '</head>', concat(CASE
    WHEN page_id % 4 = 0 THEN concat('<script type="application/ld+json">{"name":"Acme ', CAST(page_id % 97 AS VARCHAR(10)),
      '","address":{"streetAddress":"', CAST(100 + page_id AS VARCHAR(10)), ' Main St","addressLocality":"Albany","addressRegion":"NY","postalCode":"12207"}}</script>')
    WHEN page_id % 4 = 1 THEN '<meta property="og:street-address" content="9 Oak Ave, Troy, NY 12180">'
    WHEN page_id % 4 = 2 THEN '<script id="__NEXT_DATA__">{"props":{"pageProps":{"business":{"location":{"street":"7 Elm Rd","city":"Troy","zipCode":"12180"}}}}}</script>'
    ELSE '' END, '</head>')), '</body>', concat(CASE
    WHEN page_id % 8 = 3 THEN concat('<p>', chr(10), 'Acme ', CAST(page_id % 97 AS VARCHAR(10)), chr(10), '55 Park Ave, Albany, NY 12207', chr(10), '</p>')
    WHEN page_id % 16 = 7 THEN '<h2>Just a moment</h2>' ELSE '' END, '</body>')) AS html
FROM @pages
"""

# One result per order: every business has about ten, some of them repeated or unusable.
VIEWS["search_results"] = """
SELECT c_custkey + 1 AS business_id, concat('Acme ', CAST(c_custkey % 97 AS VARCHAR(10))) AS business_name, o_orderkey AS pos,
  CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN 'ftp://bad' WHEN o_orderkey % 9 = 2 THEN 'https://www.bbb.org/x'
       WHEN o_orderkey % 9 = 3 THEN 'https://www.yelp.com/biz'
       ELSE concat('https://shop', CAST(o_orderkey % 7 AS VARCHAR(10)), '.example.com:8080/p?q=1') END AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('Acme ', CAST(c_custkey % 97 AS VARCHAR(10)), ' address and contact')
       WHEN o_orderkey % 11 = 1 THEN 'Co' ELSE 'Company location' END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN '12 Oak St, Troy, NY 12180' ELSE 'official business office' END AS description
FROM @orders JOIN @customer ON o_custkey = c_custkey
"""

VIEWS["op_events"] = """
SELECT event_id, event_id AS t, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'SET' WHEN 'view' THEN 'GET'
    WHEN 'signup' THEN 'WARNING' ELSE 'DELETE' END AS type,
  CAST(user_id AS VARCHAR(20)) AS cache_key, concat('node-', CAST(user_id % 5 AS VARCHAR(5))) AS node_id,
  concat('msg ', CAST(user_id % 3 AS VARCHAR(5))) AS message,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
  value AS latency_ms, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 60 * (user_id % 4) END AS ttl
FROM @events
"""

VIEWS["requests"] = """
SELECT event_id, CAST(floor(event_id / 20) AS BIGINT) AS t, concat('d', CAST(user_id % 5 AS VARCHAR(5))) AS domain,
  CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'scrape' WHEN 'error' THEN 'other' ELSE 'default' END AS rule
FROM @events
"""

VIEWS["attempts"] = """
SELECT event_id, event_id * 20 AS t, concat('u', CAST(user_id % 6 AS VARCHAR(5))) AS username, event_type = 'purchase' AS success FROM @events
"""

# The same attempts at a coarser clock, so that many fall into one second.
VIEWS["burst_attempts"] = """
SELECT event_id, CAST(floor(event_id / 25) AS BIGINT) * 100 AS t, concat('u', CAST(user_id % 6 AS VARCHAR(5))) AS username, event_type = 'purchase' AS success FROM @events
"""

VIEWS["entries"] = """
SELECT CAST(user_id AS VARCHAR(20)) AS cache_key, max(event_id) AS last_access, count(*) AS access_count, CAST(sum(length(props)) AS BIGINT) AS size_bytes,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 100 * (user_id % 3) END AS ttl, CASE user_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM @events GROUP BY user_id
"""

VIEWS["node_status"] = """
SELECT event_id, event_id AS t, concat('node-', CAST(user_id % 5 AS VARCHAR(5))) AS node_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'healthy' END AS status,
  value AS latency_ms FROM @events
"""

VIEWS["replicas"] = """
SELECT cache_key, concat('node-', CAST(event_id % 3 AS VARCHAR(5))) AS node_id, max(t) AS ts, max_by(latency_ms, t) AS value FROM @op_events WHERE type = 'SET' GROUP BY 1, 2
"""

VIEWS["http_log"] = """
SELECT event_id, concat('s', CAST(user_id % 40 AS VARCHAR(5))) AS session_id,
  CASE user_id % 3 WHEN 0 THEN 'https://www.chamberofcommerce.com/search' WHEN 1 THEN 'https://www.trustpilot.com/search' ELSE 'https://cdn.example.com/x' END AS url,
  CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 429 WHEN 'click' THEN CASE WHEN user_id % 40 < 20 THEN 401 ELSE 200 END ELSE 200 END AS status
FROM @events
"""

VIEWS["log_records"] = """
SELECT event_id, concat('fn_', CAST(user_id % 12 AS VARCHAR(5))) AS function, value AS execution_time,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM @events
"""

VIEWS["tasks"] = """
SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status,
  o_orderkey % 101 AS progress FROM @orders
"""

VIEWS["tokens"] = """
SELECT c_name || '-secret-' || CAST(c_custkey AS VARCHAR(20)) AS token, concat('u', CAST(c_custkey % 50 AS VARCHAR(10))) AS username, c_custkey % 1000 AS expires_at FROM @customer
"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_NAME = re.compile(r"@(\w+)")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(n for n in _NAME.findall(sql) if n in VIEWS or n in TABLES))


def _fill(sql: str, pattern: str) -> str:
    return _NAME.sub(lambda m: pattern % m[1] if m[1] in VIEWS or m[1] in TABLES else m[0], sql)


class Inputs:
    """Lazy access to the tables of one directory and to the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        marked = _fill(text.replace("{", "{{").replace("}", "}}"), "{%s}")
        return self.spark.sql(marked, **{n: getattr(self, n) for n in _needs(text)})


def check_views(sql: str) -> str:
    """Complete a check SQL with the derived views it names."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for other in _needs(VIEWS[name]):
                visit(other)
            order.append(name)

    for name in _needs(sql):
        visit(name)
    views = [f"{n} AS ({_fill(VIEWS[n].strip(), '%s')})" for n in order]
    body = _fill(sql.strip(), "%s")
    if not views:
        return body
    head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    if body.startswith("WITH "):
        return head + ",\n".join(views) + ",\n" + body[len(head):]
    return head + ",\n".join(views) + "\n" + body
