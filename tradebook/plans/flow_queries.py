"""Registered queries: files, profiles and streams over data derived from the given tables."""

import uuid

from pyspark.sql import functions as F

from tradebook.operators import quality as Q
from tradebook.operators import records as R
from tradebook.plans.event_queries import (
    ALERT_SQL,
    ENRICHED,
    EXPIRING_SQL,
    METRICS,
    RATE_SQL,
    SLIDE_SQL,
    _rounded,
    lockout_sql,
    pattern_sql,
)
from tradebook.plans.quality_queries import VALIDATED
from tradebook.plans.records_queries import FIRSTS, KEY_SQL, clean_sql
from tradebook.plans.registry import query
from tradebook.session import scratch
from tradebook.sources import files as S
from tradebook.sources import tables as T
from tradebook.streaming import flows as W
from tradebook.streaming import stateful as Z


# --- files ----------------------------------------------------------------------------------

@query("read_names_csv", "SELECT business_name, row_number() OVER (ORDER BY id) AS row_id FROM (SELECT id, trim(business_name) AS business_name FROM @businesses)")
def _(i):
    path = scratch(i.spark, "names")
    i.businesses.orderBy("id").select(F.col("business_name").alias("Name")).write.option("header", True).csv(path)
    return S.read_names_csv(i.spark, path)


@query("read_business_csv", "SELECT CAST(id AS VARCHAR) AS id, trim(business_name) AS business_name, verified::VARCHAR AS verified FROM @businesses")
def _(i):
    path = scratch(i.spark, "businesses")
    S.write_export(i.businesses.select("id", "business_name", "verified"), path)
    return S.read_business_csv(i.spark, path)


@query("write_chunked_csv", f"SELECT true AS small_files, count(*) AS rows FROM ({clean_sql(True)})")
def _(i):
    path = scratch(i.spark, "chunks")
    S.write_chunked_csv(R.clean_business(i.businesses), path, 100)
    sizes = S.combine_chunks(i.spark, path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") <= 100).alias("small_files"), F.sum("n").alias("rows"))


@query("combine_chunks", f"SELECT id, business_name, address, state, zip_code, created_at FROM ({clean_sql(True)})")
def _(i):
    path = scratch(i.spark, "chunks")
    S.write_chunked_csv(R.clean_business(i.businesses), path, gzip=True)
    return S.combine_chunks(i.spark, path)


@query("combine_chunks_by_name", f"SELECT id, business_name, CASE WHEN id % 2 = 0 THEN address END AS address, state, zip_code, created_at FROM ({clean_sql(True)})")
def _(i):
    """Half of the chunks have their columns in another order, and lack one."""
    path, rows = scratch(i.spark, "chunks"), R.clean_business(i.businesses)
    S.write_chunked_csv(rows.filter("id % 2 = 0"), f"{path}/even")
    odd = rows.filter("id % 2 = 1").select("business_name", "id", "zip_code", "state", "created_at")
    odd.write.option("header", True).option("escape", '"').csv(f"{path}/odd")
    return S.combine_chunks(i.spark, f"{path}/*")


@query("write_export_json", "SELECT id, business_name, address, state, zip_code, created_at FROM @businesses WHERE verified")
def _(i):
    from tradebook.operators.dashboard import export_businesses
    path = scratch(i.spark, "export")
    out = export_businesses(i.businesses, verified_only=True)
    S.write_export(out, path, "json")
    return i.spark.read.schema(out.schema).json(path)


@query("read_json_logs", "SELECT level, function, execution_time, error, CASE WHEN event_id % 50 = 0 THEN 'broken' END AS corrupt FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CASE WHEN error IS NULL THEN 'INFO' ELSE 'ERROR' END END AS level, CASE WHEN event_id % 50 <> 0 THEN function END AS function, CASE WHEN event_id % 50 <> 0 THEN execution_time END AS execution_time, CASE WHEN event_id % 50 <> 0 THEN error END AS error FROM @log_records)")
def _(i):
    path = scratch(i.spark, "logs")
    line = F.when(F.col("event_id") % 50 == 0, "{broken").otherwise(F.to_json(F.struct(
        F.when(F.col("error").isNull(), "INFO").otherwise("ERROR").alias("level"), F.lit("worker").alias("name"),
        F.struct("function", "execution_time", "error").alias("metadata"))))
    i.log_records.select(line.alias("value")).write.text(path)
    return S.read_json_logs(i.spark, path).select(
        "level", "metadata.function", "metadata.execution_time", "metadata.error",
        F.when(F.col("_corrupt").isNotNull(), "broken").alias("corrupt"))


@query("write_error_report", f"SELECT CAST(id AS VARCHAR) AS id, count(*) AS errors FROM (SELECT id, unnest(e) AS error FROM {VALIDATED} WHERE len(e) > 0) GROUP BY id")
def _(i):
    path = scratch(i.spark, "errors")
    S.write_error_report(Q.validate_input(i.businesses), path)
    return i.spark.read.option("escape", '"').csv(path, header=True).groupBy("id").agg(F.count(F.lit(1)).alias("errors"))


@query("write_json_report", "SELECT count(*) AS total_items, count(*) FILTER (verified) AS verified FROM @businesses")
def _(i):
    path = scratch(i.spark, "report")
    S.write_json_report(i.businesses.agg(F.struct(F.count(F.lit(1)).alias("total_items"),
                                                  F.count_if("verified").alias("verified")).alias("stats")), path)
    return i.spark.read.json(path).select("stats.*")


LOG_LINES = "SELECT event_id, concat(function, ' ', CAST(event_id AS VARCHAR(20))) AS value, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 8 END AS p FROM @log_records"


def _log_folder(i, label: str) -> str:
    """Eight text files of different sizes."""
    path = scratch(i.spark, label)
    i.sql(LOG_LINES).repartition("p").select("value", "p").write.partitionBy("p").text(path)
    return path


FILE_SIZES = f"(SELECT p, sum(length(value) + 1) / 1048576.0::DOUBLE AS size_mb FROM ({LOG_LINES}) GROUP BY p)"


@query("check_source_files", f"SELECT p, round(size_mb, 6) AS size_mb, size_mb > 0.01 AS too_large FROM {FILE_SIZES}")
def _(i):
    found = S.check_source_files(i.spark, _log_folder(i, "sources") + "/*", "csv", max_mb=0.01)
    return found.select(F.regexp_extract("path", r"/p=(\d+)/", 1).cast("bigint").alias("p"), F.round("size_mb", 6).alias("size_mb"),
                        F.col("issue").isNotNull().alias("too_large"))


@query("check_json_files", "SELECT issue, count(*) AS files FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'Root must be an object or array' WHEN 2 THEN 'Too many items in array (3)' END AS issue FROM nation) GROUP BY issue")
def _(i):
    path = scratch(i.spark, "json")
    k = F.col("n_nationkey") % 4
    body = F.when(k == 0, F.concat(F.lit("{"), "n_name")).when(k == 1, F.concat(F.lit('"'), "n_name", F.lit('"'))) \
        .when(k == 2, F.lit("[1,2,3]")).otherwise(F.to_json(F.struct("n_name")))
    i.nation.select(body.alias("value"), "n_nationkey").repartition(25, "n_nationkey") \
        .write.option("maxRecordsPerFile", 1).partitionBy("n_nationkey").text(path)
    return S.check_json_files(i.spark, path + "/*/*", 2).groupBy("issue").agg(F.count(F.lit(1)).alias("files"))


ODD_ID = "CASE WHEN id = (SELECT max(id) FROM @businesses) THEN 'x' ELSE CAST(id AS VARCHAR(20)) END"


@query("check_csv_schema", f"""SELECT * FROM (VALUES ('id', 'int', NULL), ('business_name', 'string', NULL), ('day', 'date', 'Column ''day'' has unusual type: date'), ('verified', 'boolean', NULL)) v("column", type, warning)
  UNION ALL SELECT 'odd', CASE WHEN count(*) = count(TRY_CAST(odd AS INTEGER)) THEN 'int' ELSE 'string' END, NULL FROM (SELECT {ODD_ID} AS odd FROM @businesses)""")
def _(i):
    path = scratch(i.spark, "csv")
    i.sql(f"SELECT id, business_name, '2024-01-31' AS day, verified, {ODD_ID} AS odd FROM @businesses").write.option("header", True).csv(path)
    return S.check_csv_schema(i.spark, path)


@query("read_pages", "SELECT page_id, url, html FROM pages")
def _(i):
    return S.read_pages(i.spark, f"{i.sf_dir}/pages.parquet")


@query("table_profile", """SELECT 'state' AS "column", 'string' AS type, count(*) AS rows, count(*) - count(state) AS nulls FROM @businesses UNION ALL SELECT 'zip_code', 'string', count(*), count(*) - count(zip_code) FROM @businesses
  UNION ALL SELECT 'verified', 'boolean', count(*), 0 FROM @businesses""")
def _(i):
    return T.table_profile(i.businesses.select("state", "zip_code", "verified")).drop("nullable")


@query("log_file_stats", f"SELECT count(*) AS file_count, round(sum(size_mb), 6) AS total_size_mb FROM {FILE_SIZES}")
def _(i):
    return S.log_file_stats(i.spark, _log_folder(i, "logfiles") + "/*", "*.txt").select(
        "file_count", F.round("total_size_mb", 6).alias("total_size_mb"))


@query("log_files", f"SELECT round(size_mb, 6) AS size_mb, true AS dated FROM {FILE_SIZES}")
def _(i):
    return S.log_files(i.spark, _log_folder(i, "logfiles") + "/*", "*.txt").select(
        F.round("size_mb", 6).alias("size_mb"), F.col("modified").isNotNull().alias("dated"))


@query("catalog_profile", "SELECT 'kept' AS name, count(*) AS rows, true AS sized FROM @businesses UNION ALL SELECT 'verified', count(*), true FROM @businesses WHERE verified")
def _(i):
    """Two derived tables are saved, profiled and dropped from the catalog again."""
    mark, names = uuid.uuid4().hex[:8], {"kept": "true", "verified": "verified"}
    try:
        for name, chosen in names.items():
            i.businesses.select("id", "state", "zip_code", "verified").filter(chosen).write.option(
                "path", scratch(i.spark, name)).saveAsTable(f"{name}_{mark}")
        return T.catalog_profile(i.spark).filter(F.col("table").endswith(mark)).select(
            F.split("table", "_")[0].alias("name"), "rows", (F.col("size_bytes") > 0).alias("sized"))
    finally:
        for name in names:
            i.spark.sql(f"DROP TABLE IF EXISTS {name}_{mark}")


# --- streams --------------------------------------------------------------------------------

def _stream(i, sql: str):
    """A derived view as a stream over the events file: same SQL, streaming input."""
    source = W.read_stream(i.spark, i.sf_dir, i.events, "events.parquet")
    return i.spark.sql(sql.replace("@events", "{events}"), events=source)


EPOCH = 1704067200  # event time 0 of the derived views


def _timed(i, view: str, delay: str | None = "10 minutes", ended: bool | dict = False):
    """A view as a stream; ``ended`` adds its end, with the given values where a query filters rows: Spark
    filters before it takes the watermark."""
    from tradebook.plans.inputs import VIEWS
    out = _stream(i, VIEWS[view])
    if ended:
        last = getattr(i, view).orderBy(F.desc("t"), "event_id").limit(1)
        last = last.withColumns({c: F.lit(v).cast(last.schema[c].dataType) for c, v in (ended if isinstance(ended, dict) else {}).items()})
        out = W.with_end(out, last.withColumn("t", F.col("t") + 10 * 86400).withColumn("event_id", F.col("event_id") * 0 - 1))
    out = out.withColumn("ts", F.timestamp_seconds(F.col("t") + EPOCH))
    return out.withWatermark("ts", delay) if delay else out


def _run(stream, *times: str):
    """Finish the stream and turn its seconds back into those of the view."""
    out = W.run_available(stream)
    return out.withColumns({c: F.col(c) - EPOCH for c in times or ("t",)})


@query("stream_enrich_events", f"SELECT event_id, type, priority FROM {ENRICHED}")
def _(i):
    from tradebook.operators.events import enrich_events
    return W.run_available(enrich_events(_timed(i, "op_events")).select("event_id", "type", "priority"), "priority")


@query("stream_limit_rate", RATE_SQL)
def _(i):
    return _run(Z.limit_rate_stream(_timed(i, "requests", ended=True)))


@query("stream_limit_sliding", SLIDE_SQL.replace("SELECT event_id, t, domain, decision FROM steps", "SELECT event_id, t, domain, decision = 'admitted' AS allowed FROM steps"))
def _(i):
    return _run(Z.limit_sliding_stream(_timed(i, "requests", ended=True), "domain"))


@query("stream_lockouts", lockout_sql("@attempts"))
def _(i):
    return _run(Z.lockouts_stream(_timed(i, "attempts", ended=True)))


@query("stream_alerts", ALERT_SQL)
def _(i):
    return _run(Z.alerts_stream(_timed(i, "op_events", ended=True)))


@query("stream_alerts_expiring", EXPIRING_SQL)
def _(i):
    return _run(Z.alerts_stream(_timed(i, "op_events", ended=True), threshold=3, window=60, expiry=300))


@query("stream_match_pattern", pattern_sql(["WARNING", "ERROR", "SET"], 30, "node_id"))
def _(i):
    return _run(Z.match_pattern_stream(_timed(i, "op_events", ended={"type": "WARNING"}), ["WARNING", "ERROR", "SET"], 30, "node_id"), "start_t", "end_t") \
        .select("node_id", "start_t", "end_t", F.array_join("event_ids", ",").alias("ids"))


@query("stream_metrics", f"SELECT CAST(floor(t / 60) * 60 AS BIGINT) AS window_start, {METRICS} FROM {ENRICHED} GROUP BY 1")
def _(i):
    ev = _timed(i, "op_events", None, ended=True).withColumn("failed", F.col("type") == "ERROR")
    out = _rounded(W.run_available(W.metrics_stream(ev)))
    return out.withColumn("window_start", F.unix_timestamp("window_start") - EPOCH)


@query("stream_expire_ttl", """SELECT cache_key, t + ttl AS expires_at FROM (SELECT cache_key, t, coalesce(ttl, 900) AS ttl, lead(t) OVER (PARTITION BY cache_key ORDER BY t, event_id) AS n FROM @op_events WHERE type = 'SET' AND cache_key IS NOT NULL)
  WHERE n IS NULL OR n > t + ttl""")
def _(i):
    writes = _timed(i, "op_events", ended=True).filter("event_id = -1 OR type = 'SET' AND cache_key IS NOT NULL") \
        .withColumn("cache_key", F.when(F.col("event_id") == -1, "end of run").otherwise(F.col("cache_key")))
    out = _run(Z.expire_stream(writes.withColumn("ttl", F.coalesce("ttl", F.lit(900))), ["cache_key"]), "expires_at")
    return out.filter("cache_key <> 'end of run'")


@query("stream_expire_alerts", "SELECT event_id, t + 600 AS expires_at FROM @op_events WHERE type IN ('ERROR', 'WARNING')")
def _(i):
    alerts = _timed(i, "op_events", ended=True).filter("event_id = -1 OR type IN ('ERROR', 'WARNING')").withColumn("ttl", F.lit(600))
    return _run(Z.expire_stream(alerts, ["event_id"]), "expires_at").filter("event_id <> -1")


@query("stream_dedup", f"SELECT business_key FROM (SELECT {KEY_SQL} AS business_key, rn FROM {FIRSTS}) WHERE rn = 1")
def _(i):
    path = scratch(i.spark, "records")
    rows = i.businesses.withColumn("ts", F.timestamp_seconds(F.col("id") + EPOCH))
    rows.write.parquet(path)
    return W.run_available(W.dedup_stream(W.read_stream(i.spark, path, rows)).select("business_key"))


@query("stream_changed_keys", "SELECT DISTINCT cache_key FROM @op_events WHERE type IN ('SET', 'DELETE')")
def _(i):
    path, state = scratch(i.spark, "snapshots"), scratch(i.spark, "stream-state")
    W.snapshot_on_batch(_timed(i, "op_events"), lambda: i.entries, path, state).awaitTermination()
    return i.spark.read.parquet(path + "/*").select("cache_key")


@query("stream_cooldown", """WITH RECURSIVE a AS (SELECT severity AS rule_name, t, min(event_id) AS event_id FROM @op_events WHERE latency_ms > 60 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY t) AS rn FROM a),
  steps AS (SELECT t, rule_name, rn, t AS fired, true AS kept FROM b WHERE rn = 1 UNION ALL SELECT r.t, r.rule_name, r.rn, CASE WHEN r.t - s.fired < 300 THEN s.fired ELSE r.t END, r.t - s.fired >= 300 FROM steps s JOIN b r ON r.rule_name = s.rule_name AND r.rn = s.rn + 1)
  SELECT rule_name, t FROM steps WHERE kept""")
def _(i):
    raised = _timed(i, "op_events", ended={"latency_ms": 100}).filter("latency_ms > 60").withColumn("rule_name", F.col("severity"))
    return _run(Z.cooldown_stream(raised)).select("rule_name", "t")
