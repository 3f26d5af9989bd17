"""Registered queries: events, alerts, limits, node health, keyed tables."""

from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.operators import events as E
from tradebook.operators import keyed as K
from tradebook.operators import limits as L
from tradebook.operators import nodes as N
from tradebook.plans.registry import query

ENRICHED = "(SELECT *, CASE WHEN type = 'ERROR' THEN 'HIGH' WHEN type = 'WARNING' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM @op_events)"


@query("enrich_events", f"SELECT event_id, type, priority FROM {ENRICHED}")
def _(i):
    return E.enrich_events(i.op_events).select("event_id", "type", "priority")


METRICS = """count(*) AS total_events, count(*) FILTER (priority = 'HIGH') AS high_events, count(*) FILTER (priority = 'MEDIUM') AS medium_events, count(*) FILTER (priority = 'LOW') AS low_events,
  round(avg(latency_ms), 6) AS avg_processing_time, round(sum(latency_ms), 4) AS total_processing_time, max(t) AS last_event, count(*) FILTER (type = 'ERROR') AS failed_events"""


def _rounded(df):
    return df.withColumns({"avg_processing_time": F.round("avg_processing_time", 6),
                           "total_processing_time": F.round("total_processing_time", 4)})


@query("event_metrics", f"SELECT {METRICS} FROM {ENRICHED}")
def _(i):
    return _rounded(E.event_metrics(E.enrich_events(i.op_events).withColumn("failed", F.col("type") == "ERROR")))


@query("events_by_type", "SELECT type, count(*) AS count FROM @op_events GROUP BY type")
def _(i):
    return E.events_by(i.op_events, "type")


@query("metrics_by_interval", f"SELECT CAST(floor(t / 60) * 60 AS BIGINT) AS window_start, {METRICS} FROM {ENRICHED} GROUP BY 1")
def _(i):
    ev = E.enrich_events(i.op_events).withColumn("failed", F.col("type") == "ERROR").withColumn("ts", F.timestamp_seconds("t"))
    return _rounded(E.metrics_by_interval(ev)).withColumn("window_start", F.unix_timestamp("window_start"))


@query("execution_times", "SELECT function, count(*) AS calls, round(avg(execution_time), 6) AS avg_time, max(execution_time) AS max_time, count(error) AS errors FROM @log_records GROUP BY function")
def _(i):
    return E.execution_times(i.log_records).withColumn("avg_time", F.round("avg_time", 6))


# --- rate limits, lock-outs -----------------------------------------------------------------

_LIMITS = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v[0]}" for r, v in fixed.RATE_RULES.items()) + " ELSE 60 END"
_PENALTY = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v[2]}" for r, v in fixed.RATE_RULES.items()) + " ELSE 300 END"


def limit_sql(source: str, keys: list[str], limit: str, period: str, penalty: str) -> str:
    """Check SQL: sequential admit / refuse decisions as a recursion over each key's rows."""
    k = ", ".join(keys)
    join = " AND ".join(f"r.{x} = s.{x}" for x in keys)
    rk = ", ".join(f"r.{x}" for x in keys)
    live = f"list_filter(s.stamps, lambda x: x > r.t - {period})"
    blocked = "(s.until IS NOT NULL AND r.t < s.until)"
    full = f"len({live}) >= r.lim"
    return f"""WITH RECURSIVE ruled AS (SELECT event_id, t, {k}, {limit} AS lim, {penalty} AS pen, row_number() OVER (PARTITION BY {k} ORDER BY t, event_id) AS rn FROM {source}),
    steps AS (SELECT event_id, t, {k}, rn, [t] AS stamps, CAST(NULL AS BIGINT) AS until, 'admitted' AS decision FROM ruled WHERE rn = 1
      UNION ALL SELECT r.event_id, r.t, {rk}, r.rn, CASE WHEN {blocked} THEN s.stamps WHEN {full} THEN {live} ELSE list_append({live}, r.t) END,
        CASE WHEN {blocked} THEN s.until WHEN {full} THEN r.t + r.pen ELSE s.until END,
        CASE WHEN {blocked} THEN 'blocked' WHEN {full} THEN 'limited' ELSE 'admitted' END
      FROM steps s JOIN ruled r ON {join} AND r.rn = s.rn + 1)
    SELECT event_id, t, {k}, decision FROM steps"""


RATE_SQL = limit_sql("@requests", ["rule", "domain"], _LIMITS, "60", _PENALTY)
SLIDE_SQL = limit_sql("@requests", ["domain"], "10", "60", "0")


@query("limit_rate", RATE_SQL)
def _(i):
    return L.limit_rate(i.requests)


@query("limit_sliding", SLIDE_SQL.replace("SELECT event_id, t, domain, decision FROM steps", "SELECT event_id, t, domain, decision = 'admitted' AS allowed FROM steps"))
def _(i):
    return L.limit_sliding(i.requests, "domain")


@query("with_rule", f"SELECT event_id, {_LIMITS} AS max_requests, 60 AS period, {_PENALTY} AS penalty FROM @requests")
def _(i):
    return K.with_rule(i.requests).select("event_id", "max_requests", "period", "penalty")


@query("rate_limit_stats", RATE_SQL.replace("SELECT event_id, t, rule, domain, decision FROM steps", f"""SELECT rule, count(*) AS domains, count(*) FILTER (until > 400) AS blocked, CAST(sum(n) AS BIGINT) AS requests FROM (
  SELECT rule, domain, max(CASE WHEN decision = 'limited' THEN t + {_PENALTY} END) AS until, count(*) FILTER (decision = 'admitted' AND t > 400 - 60) AS n FROM steps WHERE t <= 400 GROUP BY rule, domain) GROUP BY ROLLUP (rule)"""))
def _(i):
    return E.rate_limit_stats(L.limit_rate(i.requests), 400)


def lockout_sql(source: str) -> str:
    locked = "(s.locked IS NOT NULL AND r.t - s.locked <= 300)"
    live = "list_append(list_filter(s.fails, lambda x: r.t - x < 1800), r.t)"
    return f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY t, event_id) AS rn FROM {source}),
    steps AS (SELECT event_id, t, username, success, rn, CASE WHEN success THEN CAST([] AS BIGINT[]) ELSE [t] END AS fails, CAST(NULL AS BIGINT) AS locked, CASE WHEN success THEN 'success' ELSE 'failure' END AS outcome FROM a WHERE rn = 1
      UNION ALL SELECT r.event_id, r.t, r.username, r.success, r.rn, CASE WHEN {locked} THEN s.fails WHEN r.success THEN [] ELSE {live} END,
        CASE WHEN {locked} THEN s.locked WHEN NOT r.success AND len({live}) >= 5 THEN r.t END,
        CASE WHEN {locked} THEN 'ignored' WHEN r.success THEN 'success' WHEN len({live}) >= 5 THEN 'lockout' ELSE 'failure' END
      FROM steps s JOIN a r ON r.username = s.username AND r.rn = s.rn + 1)
    SELECT event_id, t, username, success, outcome FROM steps"""


@query("lockouts", lockout_sql("@attempts"))
def _(i):
    return L.lockouts(i.attempts)


@query("lockouts_burst", lockout_sql("@burst_attempts"))
def _(i):
    return L.lockouts(i.burst_attempts)


_AS_OF = 100000


@query("failed_attempts", lockout_sql("@attempts").replace("SELECT event_id, t, username, success, outcome FROM steps", f"""SELECT username, CAST(len(list_filter(fails, lambda x: list_max(fails) - x < 1800)) AS BIGINT) AS failed_attempts, coalesce(locked IS NOT NULL AND {_AS_OF} - locked <= 300, false) AS locked
  FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY rn DESC) AS back FROM steps WHERE t <= {_AS_OF}) WHERE back = 1"""))
def _(i):
    return L.failed_attempts(L.lockouts(i.attempts.filter(F.col("t") <= _AS_OF)), _AS_OF)


# --- alerts ---------------------------------------------------------------------------------

ALERT_SQL = """WITH RECURSIVE a AS (SELECT event_id, t, message, severity, row_number() OVER (PARTITION BY message ORDER BY t, event_id) AS rn FROM @op_events),
    steps AS (SELECT event_id, t, message, severity, rn, CAST(1 AS BIGINT) AS count, map(CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])) AS notified_at, true AS kept, false AS notified FROM a WHERE rn = 1
      UNION ALL SELECT r.event_id, r.t, r.message, r.severity, r.rn, s.count + CASE WHEN dup THEN 0 ELSE 1 END,
        CASE WHEN NOT dup AND s.count + 1 >= 5 THEN map_concat(s.notified_at, map([r.severity], [r.t])) ELSE s.notified_at END, NOT dup, NOT dup AND s.count + 1 >= 5
      FROM steps s JOIN a r ON r.message = s.message AND r.rn = s.rn + 1, LATERAL (SELECT coalesce(r.t - s.notified_at[r.severity] < 300, false) AS dup) d)
    SELECT event_id, t, message, severity, count, notified FROM steps WHERE kept"""
_ALERT_TAIL = "SELECT event_id, t, message, severity, count, notified FROM steps WHERE kept"


def _alerts(i):
    return L.alerts_with_dedup(i.op_events)


def alert_check(tail: str) -> str:
    return ALERT_SQL.replace(_ALERT_TAIL, tail.replace("ALERTS", f"({_ALERT_TAIL})"))


@query("alerts_with_dedup", ALERT_SQL)
def _(i):
    return _alerts(i)


EXPIRING_SQL = """WITH RECURSIVE a AS (SELECT event_id, t, message, severity, row_number() OVER (PARTITION BY message ORDER BY t, event_id) AS rn FROM @op_events),
    steps AS (SELECT event_id, t, message, severity, rn, [t] AS stamps, map(CAST([] AS VARCHAR[]), CAST([] AS BIGINT[])) AS notified_at, CAST(1 AS BIGINT) AS count, true AS kept, false AS notified FROM a WHERE rn = 1
      UNION ALL SELECT r.event_id, r.t, r.message, r.severity, r.rn, CASE WHEN dup THEN alive ELSE list_append(alive, r.t) END,
        CASE WHEN NOT dup AND len(alive) + 1 >= 3 THEN map_concat(s.notified_at, map([r.severity], [r.t])) ELSE s.notified_at END,
        CAST(len(alive) + 1 AS BIGINT), NOT dup, NOT dup AND len(alive) + 1 >= 3
      FROM steps s JOIN a r ON r.message = s.message AND r.rn = s.rn + 1,
        LATERAL (SELECT list_filter(s.stamps, lambda x: x > r.t - 300) AS alive, coalesce(r.t - s.notified_at[r.severity] < 60, false) AS dup) d)
    SELECT event_id, t, message, severity, count, notified FROM steps WHERE kept"""


@query("alerts_expiring", EXPIRING_SQL)
def _(i):
    return L.alerts_with_dedup(i.op_events, threshold=3, window=60, expiry=300)


@query("alert_summary", alert_check("""SELECT severity, count(a.event_id) AS current, count(a.event_id) FILTER (t >= 9000 - 3600) AS last_hour, count(a.event_id) FILTER (t >= 9000 - 86400) AS last_day
  FROM (VALUES ('error'), ('warning'), ('info'), ('total')) v(severity) LEFT JOIN (SELECT event_id, t, severity AS sev FROM ALERTS) a ON severity = 'total' OR sev = severity GROUP BY severity"""))
def _(i):
    return E.alert_summary(_alerts(i), 9000)


@query("alert_stats", alert_check("""SELECT count(DISTINCT message) AS total_alerts, count(DISTINCT message) FILTER (notified) AS notified_alerts, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info, count(*) AS history_size, arg_max(message, t) AS latest_message, max(t) AS latest_t FROM ALERTS"""))
def _(i):
    return E.alert_stats(_alerts(i))


@query("filter_alerts", alert_check("SELECT * FROM ALERTS WHERE severity = 'error' AND t BETWEEN 100 AND 9000"))
def _(i):
    return E.filter_alerts(_alerts(i), severity="ERROR", start=100, end=9000)


@query("recent_alerts", alert_check("SELECT * FROM ALERTS ORDER BY t DESC, event_id DESC LIMIT 100"))
def _(i):
    return E.recent_alerts(_alerts(i), 100)


@query("trim_history", "SELECT message, count(*) AS count FROM (SELECT * FROM @op_events ORDER BY t DESC, event_id DESC LIMIT 1000) GROUP BY message")
def _(i):
    return E.trim_history(i.op_events, 1000)[1]


@query("expire_alerts", alert_check("SELECT message, count(*) AS count FROM ALERTS WHERE t > 9000 - 600 GROUP BY message"))
def _(i):
    return E.expire_alerts(_alerts(i), 9000, 600)[1]


# --- patterns -------------------------------------------------------------------------------

def pattern_sql(types: list[str], within: int, by: str, cond: str = "true", reuse: bool = False) -> str:
    """Check SQL: ordered pattern of two or more different event types."""
    arr = "[" + ", ".join(f"'{t}'" for t in types) + "]"
    k = len(types)
    fresh = "(s.start IS NULL OR r.t - s.start > {w})".format(w=within)
    n = f"CASE WHEN {fresh} THEN 0 ELSE s.n END"
    hit = f"(r.type = {arr}[{n} + 1])"
    again = f"(r.type = '{types[0]}')" if reuse else "false"
    return f"""WITH RECURSIVE e AS (SELECT event_id, t, type, {by} AS k, row_number() OVER (PARTITION BY {by} ORDER BY t, event_id) AS rn FROM @op_events WHERE list_contains({arr}, type) AND {cond}),
    steps AS (SELECT event_id, t, k, rn, CASE WHEN type = '{types[0]}' THEN t END AS start, CASE WHEN type = '{types[0]}' THEN 1 ELSE 0 END AS n, CASE WHEN type = '{types[0]}' THEN [event_id] ELSE [] END AS ids,
        CAST(NULL AS BIGINT) AS m_start, CAST(NULL AS BIGINT[]) AS m_ids FROM e WHERE rn = 1
      UNION ALL SELECT r.event_id, r.t, r.k, r.rn,
        CASE WHEN {hit} AND {n} + 1 = {k} THEN CASE WHEN {again} THEN r.t END WHEN {hit} AND {n} = 0 THEN r.t WHEN {fresh} THEN NULL ELSE s.start END,
        CASE WHEN {hit} AND {n} + 1 = {k} THEN CASE WHEN {again} THEN 1 ELSE 0 END WHEN {hit} THEN {n} + 1 ELSE {n} END,
        CASE WHEN {hit} AND {n} + 1 = {k} THEN CASE WHEN {again} THEN [r.event_id] ELSE [] END WHEN {hit} THEN list_append(CASE WHEN {fresh} THEN [] ELSE s.ids END, r.event_id) WHEN {fresh} THEN [] ELSE s.ids END,
        CASE WHEN {hit} AND {n} + 1 = {k} THEN s.start END, CASE WHEN {hit} AND {n} + 1 = {k} THEN list_append(s.ids, r.event_id) END
      FROM steps s JOIN e r ON r.k = s.k AND r.rn = s.rn + 1)
    SELECT k AS node_id, m_start AS start_t, t AS end_t, array_to_string(m_ids, ',') AS ids FROM steps WHERE m_ids IS NOT NULL"""


def _pattern(df):
    return df.select("node_id", "start_t", "end_t", F.array_join("event_ids", ",").alias("ids"))


@query("match_pattern", pattern_sql(["WARNING", "ERROR", "SET"], 30, "node_id"))
def _(i):
    return _pattern(L.match_pattern(i.op_events, ["WARNING", "ERROR", "SET"], 30, by="node_id"))


@query("match_pattern_reuse", pattern_sql(["ERROR", "SET", "ERROR"], 60, "node_id", "latency_ms > 10", True))
def _(i):
    return _pattern(L.match_pattern(i.op_events, ["ERROR", "SET", "ERROR"], 60, by="node_id",
                                    metadata=F.col("latency_ms") > 10, reuse_completing_event=True))


@query("match_pattern_global", pattern_sql(["WARNING", "DELETE"], 3, "'all'"))
def _(i):
    return _pattern(L.match_pattern(i.op_events, ["WARNING", "DELETE"], 3).withColumn("node_id", F.lit("all")))


@query("match_pattern_unordered", """WITH RECURSIVE e AS (SELECT event_id, t, type, node_id AS k, row_number() OVER (PARTITION BY node_id ORDER BY t, event_id) AS rn FROM @op_events WHERE type IN ('WARNING', 'ERROR')),
    steps AS (SELECT event_id, t, k, rn, t AS start, [type] AS kinds, [event_id] AS ids, CAST(NULL AS BIGINT[]) AS m_ids, CAST(NULL AS BIGINT) AS m_start FROM e WHERE rn = 1
      UNION ALL SELECT event_id, t, k, rn, CASE WHEN done THEN NULL ELSE start END, CASE WHEN done THEN [] ELSE kinds END, CASE WHEN done THEN [] ELSE ids END, CASE WHEN done THEN ids END, CASE WHEN done THEN start END FROM (
        SELECT *, len(kinds) = 2 AND len(list_distinct(kinds)) = 2 AS done FROM (
          SELECT r.event_id, r.t, r.k, r.rn, CASE WHEN s.start IS NULL OR r.t - s.start > 20 THEN r.t ELSE s.start END AS start,
            CASE WHEN s.start IS NULL OR r.t - s.start > 20 THEN [r.type] ELSE list_append(s.kinds, r.type) END AS kinds,
            CASE WHEN s.start IS NULL OR r.t - s.start > 20 THEN [r.event_id] ELSE list_append(s.ids, r.event_id) END AS ids
          FROM steps s JOIN e r ON r.k = s.k AND r.rn = s.rn + 1)))
    SELECT k AS node_id, m_start AS start_t, t AS end_t, array_to_string(m_ids, ',') AS ids FROM steps WHERE m_ids IS NOT NULL""")
def _(i):
    return _pattern(L.match_pattern(i.op_events, ["WARNING", "ERROR"], 20, by="node_id", ordered=False))


# --- nodes ----------------------------------------------------------------------------------

@query("node_uptime", """SELECT event_id, t, node_id, status, CAST(sum(CASE WHEN status = 'healthy' THEN d ELSE 0 END) OVER w AS BIGINT) AS uptime, CAST(sum(CASE WHEN status <> 'healthy' THEN d ELSE 0 END) OVER w AS BIGINT) AS downtime,
  status <> 'healthy' AND sum(CASE WHEN status <> 'healthy' THEN d ELSE 0 END) OVER w > 300 AS down_alert
  FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY node_id ORDER BY t, event_id), 0) AS d FROM @node_status) WINDOW w AS (PARTITION BY node_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""")
def _(i):
    return N.node_uptime(i.node_status, chunk_seconds=500)


@query("consecutive_errors", """SELECT event_id, t, node_id, status, streak, streak >= 3 AS needs_recovery, status <> 'error' AND prev > 0 AS recovered, CASE WHEN status <> 'error' AND prev > 0 THEN prev END AS previous_errors FROM (
  SELECT *, coalesce(lag(streak) OVER (PARTITION BY node_id ORDER BY t, event_id), 0) AS prev FROM (
    SELECT *, count(*) FILTER (status = 'error') OVER (PARTITION BY node_id, island ORDER BY t, event_id) AS streak FROM (
      SELECT *, count(*) FILTER (status <> 'error') OVER (PARTITION BY node_id ORDER BY t, event_id) AS island FROM @node_status)))""")
def _(i):
    return N.consecutive_errors(i.node_status, chunk_seconds=40)


def health_sql(by: str) -> str:
    """Check SQL of the health figures per ``by`` expression."""
    return f"""SELECT g, count(*) AS total_nodes, count(*) FILTER (last = 'healthy') AS healthy_nodes, count(*) FILTER (last = 'healthy') * 100.0::DOUBLE / count(*) AS availability,
      sum(errors)::DOUBLE / count(*) AS error_rate, sum(lat) / sum(n) AS avg_latency
      FROM (SELECT {by} AS g, node_id, arg_max(status, event_id) AS last, count(*) FILTER (status = 'error') AS errors, sum(latency_ms) AS lat, count(latency_ms) AS n FROM @node_status GROUP BY 1, 2) GROUP BY g"""


@query("system_health", f"SELECT total_nodes, healthy_nodes, availability, error_rate, round(avg_latency, 6) AS avg_latency FROM ({health_sql('0')})")
def _(i):
    return N.system_health(i.node_status).withColumn("avg_latency", F.round("avg_latency", 6))


@query("health_series", f"SELECT g AS t, total_nodes, healthy_nodes, availability, error_rate, round(avg_latency, 6) AS avg_latency FROM ({health_sql('CAST((floor(t / 60) + 1) * 60 AS BIGINT)')})")
def _(i):
    return N.health_series(i.node_status).withColumn("avg_latency", F.round("avg_latency", 6))


@query("threshold_rules", f"""WITH RECURSIVE h AS ({health_sql('CAST((floor(t / 60) + 1) * 60 AS BIGINT)')}),
  a AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY t) AS rn FROM (
    SELECT g AS t, 'system_availability' AS rule_name, 'critical' AS severity, 'System availability is below 90%: Current availability: ' || printf('%.2f', availability) || '%' AS message FROM h WHERE availability < 90
    UNION ALL SELECT g, 'unhealthy_nodes', 'critical', 'Too many unhealthy nodes: ' || healthy_nodes || '/' || total_nodes || ' nodes are healthy' FROM h WHERE healthy_nodes / total_nodes * 100 < 80
    UNION ALL SELECT g, 'high_latency', 'warning', 'High system latency detected: Average latency is ' || printf('%.2f', avg_latency) || 'ms' FROM h WHERE avg_latency > 100
    UNION ALL SELECT g, 'error_rate', 'warning', 'High error rate detected: Error rate is ' || printf('%.2f', error_rate) || '%' FROM h WHERE error_rate > 2)),
  steps AS (SELECT t, rule_name, severity, message, rn, t AS fired, true AS kept FROM a WHERE rn = 1
    UNION ALL SELECT r.t, r.rule_name, r.severity, r.message, r.rn, CASE WHEN r.t - s.fired < 300 THEN s.fired ELSE r.t END, r.t - s.fired >= 300 FROM steps s JOIN a r ON r.rule_name = s.rule_name AND r.rn = s.rn + 1)
  SELECT rule_name, t, severity, message FROM steps WHERE kept""")
def _(i):
    rules = [r if r.name != "error_rate" else N.HealthRule(r.name, r.severity, lambda: F.col("error_rate") > 2, r.message)
             for r in N.default_rules()]
    return N.threshold_rules(N.health_series(i.node_status), rules)


# --- keyed tables ---------------------------------------------------------------------------

LOOKUP = """(SELECT event_id, t, cache_key, hit FROM (SELECT *, coalesce(w.exp >= t, false) AS hit FROM (SELECT *, last_value(CASE WHEN type IN ('SET', 'DELETE') THEN struct_pack(exp := CASE WHEN type = 'SET' THEN t + coalesce(ttl, 3600) END) END IGNORE NULLS) OVER
  (PARTITION BY cache_key ORDER BY t, event_id) AS w FROM @op_events)) WHERE type = 'GET')"""


@query("cache_lookup", f"SELECT * FROM {LOOKUP}")
def _(i):
    return K.cache_lookup(i.op_events, chunk_seconds=500)


@query("hit_ratio", f"SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 2) AS hit_ratio FROM {LOOKUP}")
def _(i):
    return K.hit_ratio(K.cache_lookup(i.op_events), 2)


@query("insert_missing", "SELECT DISTINCT user_id AS id, CAST(NULL AS VARCHAR) AS name, 'user' AS kind FROM events UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(i):
    target = i.events.select(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("user").alias("kind")).distinct()
    rows = i.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.insert_missing(target, rows, ["id"], {"kind": F.lit("customer")})


@query("reconcile_replicas", """SELECT * FROM (SELECT r.*, max(ts) OVER (PARTITION BY cache_key) AS correct_ts, last_value(value) OVER (PARTITION BY cache_key ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS correct_value FROM @replicas r)
  WHERE value IS DISTINCT FROM correct_value OR ts <> correct_ts""")
def _(i):
    return K.reconcile_replicas(i.replicas)


_SNAP = "SELECT cache_key, last_access - 1 AS last_access, access_count, size_bytes, ttl, priority FROM @entries WHERE priority <> 'LOW'"


@query("restore_snapshot", f"SELECT * FROM @entries WHERE cache_key NOT IN (SELECT cache_key FROM ({_SNAP})) UNION ALL {_SNAP}")
def _(i):
    snap = i.entries.filter("priority <> 'LOW'").withColumn("last_access", F.col("last_access") - 1)
    return K.restore_snapshot(i.entries, snap)


@query("changed_keys", "SELECT DISTINCT cache_key FROM @op_events WHERE type IN ('SET', 'DELETE') AND t > 9900")
def _(i):
    return K.changed_keys(i.op_events, 9900)


@query("incremental_snapshot", "SELECT * FROM @entries WHERE cache_key IN (SELECT cache_key FROM @op_events WHERE type IN ('SET', 'DELETE') AND t > 9900)")
def _(i):
    return K.incremental_snapshot(i.entries, i.op_events, 9900, whole_if_unchanged=False)


@query("full_snapshot", "SELECT * FROM @entries")
def _(i):
    return K.incremental_snapshot(i.entries, i.op_events, F.lit(10**15))


@query("restore_chain", """WITH times AS (SELECT unnest([max(t) // 3, 2 * max(t) // 3, max(t)]) AS at_t FROM @op_events),
  writes AS (SELECT at_t, cache_key, t, latency_ms, type, row_number() OVER (PARTITION BY at_t, cache_key ORDER BY t DESC, event_id DESC) AS rn FROM times JOIN @op_events ON t <= at_t WHERE type IN ('SET', 'DELETE') AND cache_key IS NOT NULL)
  SELECT cache_key, t, latency_ms, at_t FROM writes WHERE rn = 1 AND type = 'SET'""")
def _(i):
    """A full snapshot and two increments of the cache, restored at each of the three times."""
    from tradebook.session import settle
    end = i.op_events.agg(F.max("t")).collect()[0][0]
    times = [end // 3, 2 * end // 3, end]

    def cache(at):
        writes = i.op_events.filter((F.col("t") <= at) & F.col("type").isin("SET", "DELETE") & F.col("cache_key").isNotNull())
        last = writes.groupBy("cache_key").agg(F.max(F.struct("t", "event_id", "type", "latency_ms")).alias("w"))
        return last.filter("w.type = 'SET'").select("cache_key", "w.t", "w.latency_ms")

    chain = K.full_snapshot(cache(times[0]), times[0])
    for since, at in zip(times, times[1:]):
        chain = chain.unionByName(K.snapshot_increment(cache(at), i.op_events, at, since))
    chain = settle(chain)
    first, *more = [K.restore_chain(chain, at).withColumn("at_t", F.lit(at).cast("bigint")) for at in times]
    return first.unionAll(more[0]).unionAll(more[1])


@query("expire_ttl", "SELECT * FROM @entries WHERE ttl IS NULL OR 9950 < last_access + ttl")
def _(i):
    return K.expire_ttl(i.entries, 9950)


@query("expire_ttl_cache", "SELECT * FROM (SELECT * REPLACE (CASE WHEN ttl = 100 THEN 0 ELSE ttl END AS ttl) FROM @entries) WHERE ttl IS NULL OR (ttl <> 0 AND 9950 <= last_access + ttl)")
def _(i):
    return K.expire_ttl(i.entries.withColumn("ttl", F.when(F.col("ttl") == 100, 0).otherwise(F.col("ttl"))), 9950, zero_ttl="now", inclusive=False)


_EXP = "(SELECT *, last_access + coalesce(ttl, 3600) AS expires_at FROM @entries)"


@query("trim_cache", f"SELECT * FROM {_EXP} WHERE expires_at >= 9000 ORDER BY expires_at DESC, cache_key DESC LIMIT 100")
def _(i):
    return K.trim_cache(i.entries.withColumn("expires_at", F.col("last_access") + F.coalesce("ttl", F.lit(3600))), 9000, 100, 80)


_EVICT = {
    "LRU": "last_access, cache_key", "LFU": "access_count, cache_key", "TTL": "coalesce(ttl, 0), cache_key",
    "PRIORITY": "CASE priority WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, cache_key",
}
for _s, _o in _EVICT.items():
    def _run(i, s=_s):
        return K.evict_to_budget(i.entries, s, 50000).select("cache_key", "freed_bytes")
    query(f"evict_{_s.lower()}", f"""SELECT cache_key, freed_bytes FROM (SELECT cache_key, size_bytes, CAST(sum(size_bytes) OVER (ORDER BY {_o} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed_bytes FROM @entries)
      WHERE (SELECT sum(size_bytes) FROM @entries) >= 50000 AND freed_bytes - size_bytes < (SELECT sum(size_bytes) FROM @entries) - 35000""")(_run)


@query("cap_tiers", """SELECT e.*, CASE WHEN h.cache_key IS NOT NULL THEN 'HIGH' WHEN m.cache_key IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM @entries e
  LEFT JOIN (SELECT cache_key FROM @entries WHERE priority = 'HIGH' ORDER BY last_access DESC, cache_key DESC LIMIT 20) h USING (cache_key)
  LEFT JOIN (SELECT cache_key FROM @entries WHERE priority IN ('HIGH', 'MEDIUM') AND cache_key NOT IN (SELECT cache_key FROM @entries WHERE priority = 'HIGH' ORDER BY last_access DESC, cache_key DESC LIMIT 20) ORDER BY last_access DESC, cache_key DESC LIMIT 40) m USING (cache_key)""")
def _(i):
    return K.cap_tiers(i.entries, 20, 40)


@query("keep_last_n", "SELECT cache_key, last_access FROM @entries ORDER BY last_access DESC LIMIT 25")
def _(i):
    return K.keep_last_n(i.entries, 25, "last_access").select("cache_key", "last_access")


@query("keep_last_n_by_group", "SELECT node_id, event_id FROM (SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY event_id DESC) AS rn FROM @op_events) WHERE rn <= 7")
def _(i):
    return K.keep_last_n(i.op_events, 7, "event_id", ["node_id"]).select("node_id", "event_id")


@query("tier_counts", "SELECT count(*) AS total_items, count(*) FILTER (priority = 'HIGH') AS high_priority, count(*) FILTER (priority = 'MEDIUM') AS medium_priority, count(*) FILTER (priority = 'LOW') AS low_priority FROM @entries")
def _(i):
    return K.tier_counts(i.entries)


@query("task_status", "SELECT count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'in_progress') AS in_progress, avg(progress) AS total_progress FROM @tasks")
def _(i):
    return K.task_status(i.tasks)
