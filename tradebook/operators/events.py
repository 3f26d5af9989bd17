"""Operational events, alerts and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.text import event_priority
from tradebook.operators.keyed import _newest


def enrich_events(events: DataFrame) -> DataFrame:
    """Attach the priority of the event type (batch or stream)."""
    return events.withColumn("priority", event_priority("type"))


def event_metrics(events: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Totals, processing times, last event and failures, one row (or one per group).

    Needs type, priority, t, latency_ms and optionally failed. Works on streams.
    """
    failed = F.count_if("failed") if "failed" in events.columns else F.lit(0).cast("bigint")
    out = [F.count(F.lit(1)).alias("total_events"),
           *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_events") for p in ("HIGH", "MEDIUM", "LOW")],
           F.avg("latency_ms").alias("avg_processing_time"), F.sum("latency_ms").alias("total_processing_time"),
           F.max("t").alias("last_event"), failed.alias("failed_events")]
    return events.groupBy(*by).agg(*out) if by else events.agg(*out)


def events_by(events: DataFrame, col: str) -> DataFrame:
    return events.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def metrics_by_interval(events: DataFrame, every: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """event_metrics on tumbling event-time windows (batch or watermarked stream)."""
    out = event_metrics(events, [F.window(ts, every)])
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def filter_alerts(alerts: DataFrame, severity: str | None = None, rule: str | None = None,
                  start=None, end=None, limit: int | None = None) -> DataFrame:
    """Alerts of a severity, rule and inclusive time range; with ``limit`` the newest ones."""
    out = alerts
    if severity is not None:
        out = out.filter(F.col("severity") == severity.lower())
    if rule is not None:
        out = out.filter(F.col("rule_name") == rule)
    if start is not None:
        out = out.filter(F.col("t") >= start)
    if end is not None:
        out = out.filter(F.col("t") <= end)
    return recent_alerts(out, limit) if limit is not None else out


def recent_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("t"), F.desc("event_id")).limit(limit)


def trim_history(alerts: DataFrame, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The newest ``size`` alerts and the recounted messages."""
    kept = _newest(alerts, [F.desc("t"), F.desc("event_id")], size)
    return kept, events_by(kept, "message")


def expire_alerts(alerts: DataFrame, as_of: int, older_than: int) -> tuple[DataFrame, DataFrame]:
    """Alerts younger than ``older_than`` seconds at ``as_of`` and the recounted messages."""
    kept = alerts.filter(F.col("t") > as_of - older_than)
    return kept, events_by(kept, "message")


def alert_summary(alerts: DataFrame, as_of: int) -> DataFrame:
    """Alerts per severity: all, last hour, last day. Severities without alerts show zeros; the
    row ``total`` sums up."""
    spans = {"current": F.lit(True), "last_hour": F.col("t") >= as_of - 3600, "last_day": F.col("t") >= as_of - 86400}
    # one row of a few sums, turned into rows afterwards
    sums = alerts.agg(*[F.count_if(cond & ((F.col("severity") == s) if s != "total" else F.lit(True))).alias(f"{s}_{name}")
                        for s in (*fixed.SEVERITIES, "total") for name, cond in spans.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), *[F.col(f"{s}_{name}").alias(name) for name in spans])
                     for s in (*fixed.SEVERITIES, "total")])
    return sums.select(F.inline(rows))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Distinct messages, notified messages, severity counts, size and the latest alert, one row."""
    latest = F.max(F.struct("t", "event_id", "message"))
    return alerts.agg(
        F.count_distinct("message").alias("total_alerts"),
        F.count_distinct(F.when(F.col("notified"), F.col("message"))).alias("notified_alerts"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES],
        F.count(F.lit(1)).alias("history_size"), latest["message"].alias("latest_message"), latest["t"].alias("latest_t"))


def rate_limit_stats(decisions: DataFrame, as_of: int,
                     rules: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Per rule and overall (rule NULL): domains, domains blocked at ``as_of`` and admitted
    requests within the rule's period before it."""
    from tradebook.operators.keyed import with_rule

    ruled = with_rule(decisions.filter(F.col("t") <= as_of), rules)
    per = ruled.groupBy("rule", "domain").agg(
        F.max(F.when(F.col("decision") == "limited", F.col("t") + F.col("penalty"))).alias("_until"),
        F.count_if((F.col("decision") == "admitted") & (F.col("t") > F.lit(as_of) - F.col("period"))).alias("_n"))
    return per.rollup("rule").agg(
        F.count(F.lit(1)).alias("domains"), F.count_if(F.col("_until") > as_of).alias("blocked"),
        F.sum("_n").alias("requests"))


def execution_times(logs: DataFrame) -> DataFrame:
    """Calls, mean and longest duration and errors per function of a log."""
    return logs.groupBy("function").agg(
        F.count(F.lit(1)).alias("calls"), F.avg("execution_time").alias("avg_time"),
        F.max("execution_time").alias("max_time"), F.count_if(F.col("error").isNotNull()).alias("errors"))
