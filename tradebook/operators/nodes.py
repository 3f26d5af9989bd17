"""Node health from status logs (event_id, t, node_id, status)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.plans.scale import CHUNK, chunk_window, spaced, with_row_chunks

_KEYS = ["node_id"]
_ORDER = ["t", "event_id"]


def node_uptime(status: DataFrame, chunk_seconds: int = 3600, limit: int = 300, most_rows: int | None = None) -> DataFrame:
    """Running up- and downtime per node and check.

    The time since the node's previous check counts as uptime when the current status is healthy,
    else as downtime. ``down_alert`` marks an unhealthy check with more than ``limit`` seconds of
    downtime. Nodes are few and logs long, so every node is cut into time chunks (of ``most_rows`` rows at
    most, or about) that hand over their last check and their totals.
    """
    local = chunk_window(_KEYS, _ORDER)
    rows = with_row_chunks(status, _KEYS, _ORDER, chunk_seconds, most_rows).withColumn("_lag", F.col("t") - F.lag("t").over(local))
    healthy = F.col("status") == "healthy"
    first = F.struct("t", "event_id", "status")
    sums = rows.groupBy(*_KEYS, CHUNK).agg(
        F.coalesce(F.sum(F.when(healthy, F.col("_lag"))), F.lit(0)).alias("_up"),
        F.coalesce(F.sum(F.when(~healthy, F.col("_lag"))), F.lit(0)).alias("_down"),
        F.min(first).alias("_first"), F.max("t").alias("_last"))
    along = Window.partitionBy(*_KEYS).orderBy(CHUNK)
    gap = F.coalesce(F.col("_first.t") - F.lag("_last").over(along), F.lit(0))
    sums = sums.withColumn("_gap", gap).withColumn("_ok", F.col("_first.status") == "healthy") \
        .withColumn("_up_all", F.col("_up") + F.when(F.col("_ok"), F.col("_gap")).otherwise(F.lit(0))) \
        .withColumn("_down_all", F.col("_down") + F.when(F.col("_ok"), F.lit(0)).otherwise(F.col("_gap")))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    handed = sums.select(*_KEYS, CHUNK, "_gap", "_first.event_id",
                         F.coalesce(F.sum("_up_all").over(before), F.lit(0)).alias("_up0"),
                         F.coalesce(F.sum("_down_all").over(before), F.lit(0)).alias("_down0")) \
        .withColumnRenamed("event_id", "_first_id")
    joined = rows.join(handed, [*_KEYS, CHUNK])
    step = F.when(F.col("event_id") == F.col("_first_id"), F.col("_gap")).otherwise(F.col("_lag"))
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    up = F.sum(F.when(healthy, step).otherwise(F.lit(0))).over(running) + F.col("_up0")
    down = F.sum(F.when(~healthy, step).otherwise(F.lit(0))).over(running) + F.col("_down0")
    return joined.withColumns({"uptime": up, "downtime": down}).select(
        "event_id", "t", "node_id", "status", "uptime", "downtime",
        (~healthy & (F.col("downtime") > limit)).alias("down_alert"))


def consecutive_errors(status: DataFrame, n: int = 3, chunk_seconds: int = 3600, most_rows: int | None = None) -> DataFrame:
    """Error streak per node and check, whether it calls for recovery, and recoveries.

    ``needs_recovery`` marks streaks of ``n`` and more; ``recovered`` marks a non-error right
    after an error, ``previous_errors`` the streak it ended.
    """
    bad = F.col("status") == "error"
    local = chunk_window(_KEYS, _ORDER)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_row_chunks(status, _KEYS, _ORDER, chunk_seconds, most_rows).withColumn("_n", F.row_number().over(local)) \
        .withColumn("_reset", F.max(F.when(~bad, F.col("_n"))).over(running))
    sums = rows.groupBy(*_KEYS, CHUNK).agg(
        F.max("_n").alias("_rows"), F.max("_reset").alias("_last_reset"))
    along = Window.partitionBy(*_KEYS).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # rows of all chunks up to this one, and the overall position of the last reset
    placed = sums.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))) \
        .withColumn("_reset_at", F.col("_offset") + F.col("_last_reset"))
    handed = placed.select(*_KEYS, CHUNK, "_offset",
                           F.coalesce(F.max("_reset_at").over(before), F.lit(0)).alias("_reset0"))
    joined = rows.join(handed, [*_KEYS, CHUNK])
    at = F.col("_offset") + F.col("_n")
    last_reset = F.coalesce(F.col("_offset") + F.col("_reset"), F.col("_reset0"))
    streak = F.when(bad, at - last_reset).otherwise(F.lit(0))
    # streak just before this row
    prev_reset = F.coalesce(
        F.col("_offset") + F.max(F.when(~bad, F.col("_n"))).over(local.rowsBetween(Window.unboundedPreceding, -1)),
        F.col("_reset0"))
    prev = (at - 1) - prev_reset
    return joined.select(
        "event_id", "t", "node_id", "status", streak.cast("bigint").alias("streak"),
        (streak >= n).alias("needs_recovery"), (~bad & (prev > 0)).alias("recovered"),
        F.when(~bad & (prev > 0), prev.cast("bigint")).alias("previous_errors"))


def system_health(status: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes, healthy nodes (by latest check), availability percent and mean errors per node.

    Mean latency is added when the log has ``latency_ms``; ``by`` gives one row per group.
    """
    latency = "latency_ms" in status.columns
    nodes = status.groupBy(*by, "node_id").agg(
        F.max(F.struct("t", "event_id", "status")).alias("_last"),
        F.count_if(F.col("status") == "error").alias("_errors"),
        *([F.sum("latency_ms").alias("_lat"), F.count("latency_ms").alias("_lat_n")] if latency else []))
    total = F.count(F.lit(1))
    healthy = F.count_if(F.col("_last.status") == "healthy")
    out = [total.alias("total_nodes"), healthy.alias("healthy_nodes"),
           F.coalesce(F.try_divide(healthy * 100.0, total), F.lit(0.0)).alias("availability"),
           F.coalesce(F.try_divide(F.sum("_errors"), total), F.lit(0.0)).alias("error_rate")]
    if latency:
        out.append(F.try_divide(F.sum("_lat"), F.sum("_lat_n")).alias("avg_latency"))
    return nodes.groupBy(*by).agg(*out) if by else nodes.agg(*out)


@dataclass(frozen=True)
class HealthRule:
    """A named condition over a health row and the text it raises."""

    name: str
    severity: str
    condition: Callable[[], Column]
    message: Callable[[], Column]


def default_rules() -> list[HealthRule]:
    conditions = {
        "system_availability": lambda: F.col("availability") < 90,
        "unhealthy_nodes": lambda: F.try_divide(F.col("healthy_nodes"), F.col("total_nodes")) * 100 < 80,
        "high_latency": lambda: F.col("avg_latency") > 100,
        "error_rate": lambda: F.col("error_rate") > 5,
    }
    return [HealthRule(name, severity, conditions[name],
                       lambda template=template, cols=cols: F.format_string(template, *[F.col(c) for c in cols]))
            for name, severity, template, cols in fixed.HEALTH_RULES]


def threshold_rules(health: DataFrame, rules: Sequence[HealthRule] | None = None, cooldown: int = 300,
                    t: str = "t") -> DataFrame:
    """Alerts of the rules over a health series; a rule stays silent for ``cooldown`` seconds
    after it fired."""
    rules = default_rules() if rules is None else rules
    fired = F.array_compact(F.array(*[F.when(r.condition(), F.struct(
        F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), r.message().alias("message")))
        for r in rules]))
    raised = health.select(F.col(t).alias("t"), F.explode(fired).alias("_a")).select("t", "_a.*")
    kept = spaced(raised.withColumn("_id", F.lit(0)), ["rule_name"], "t", "_id", cooldown).select("rule_name", "t")
    return raised.join(kept, ["rule_name", "t"])


def health_series(status: DataFrame, every: int = 60) -> DataFrame:
    """System health per interval of ``every`` seconds; ``t`` is the end of the interval."""
    stamped = status.withColumn("t_end", (F.floor(F.col("t") / every) + 1) * every)
    return system_health(stamped, ["t_end"]).withColumnRenamed("t_end", "t")
