"""Operators over keyed tables: look-ups, retention, reconciliation, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.text import mask_token
from tradebook.plans.scale import CHUNK, chunk_window, first_rows, running_total, with_row_chunks


def active_tokens(df: DataFrame, now) -> DataFrame:
    """Unexpired tokens with only their first characters shown."""
    return df.filter(F.col("expires_at") > F.lit(now)).withColumn("token", mask_token("token"))


def cache_lookup(log: DataFrame, default_ttl: int = 3600, chunk_seconds: int = 3600, most_rows: int | None = None) -> DataFrame:
    """Hit or miss of every GET against the latest SET or DELETE of its key.

    ``log`` has event_id, t, type, cache_key and ttl; (t, event_id) orders it. A hit is a SET that
    has not expired at the time of the request. Keys are cut into time chunks; only the last write
    of every chunk is handed along, so a hot key is spread over many tasks.
    """
    write = F.when(F.col("type").isin("SET", "DELETE"), F.struct(
        "t", "event_id", F.when(F.col("type") == "SET", F.col("t") + F.coalesce("ttl", F.lit(default_ttl)))
        .alias("expires_at")))
    rows = with_row_chunks(log.filter(F.col("type").isin("SET", "DELETE", "GET")).select(
        "event_id", "t", "type", "cache_key", write.alias("_w")), ["cache_key"], ["t", "event_id"], chunk_seconds, most_rows)
    last = rows.groupBy("cache_key", CHUNK).agg(F.max("_w").alias("_w"))
    before = Window.partitionBy("cache_key").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select("cache_key", CHUNK, F.max("_w").over(before).alias("_before"))
    local = chunk_window(["cache_key"], ["t", "event_id"]).rowsBetween(Window.unboundedPreceding, 0)
    # (t, event_id) leads the struct, so the maximum is the latest write
    seen = rows.join(handed, ["cache_key", CHUNK]).withColumn(
        "_latest", F.coalesce(F.max("_w").over(local), F.col("_before")))
    return seen.filter("type = 'GET'").select(
        "event_id", "t", "cache_key",
        F.coalesce(F.col("_latest.expires_at") >= F.col("t"), F.lit(False)).alias("hit"))


def hit_ratio(lookups: DataFrame, digits: int | None = None) -> DataFrame:
    ratio = F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0))
    return lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
                       (F.round(ratio, digits) if digits is not None else ratio).alias("hit_ratio"))


def with_rule(requests: DataFrame, rules: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """Add the limit, period and penalty of every request's rule, the default's for unknown rules.

    Rules are a handful of literals, so they are looked up in the row instead of being joined.
    """
    rules = rules or fixed.RATE_RULES
    names = ("max_requests", "period", "penalty")
    out = {}
    for k, name in enumerate(names):
        value = F.lit(rules["default"][k])
        for rule, values in rules.items():
            if rule != "default":
                value = F.when(F.col("rule") == rule, F.lit(values[k])).otherwise(value)
        out[name] = value
    return requests.withColumns(out)


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str],
                   defaults: dict[str, Column] | None = None) -> DataFrame:
    """The target plus those rows whose key it lacks; absent columns take their default or NULL."""
    new = rows.join(target.select(*keys).distinct(), list(keys), "left_anti").dropDuplicates(list(keys))
    for name, value in (defaults or {}).items():
        if name not in new.columns:
            new = new.withColumn(name, value)
    return target.unionByName(new.select(*[c for c in new.columns if c in target.columns]), allowMissingColumns=True)


def reconcile_replicas(replicas: DataFrame, key: str = "cache_key", ts: str = "ts", value: str = "value") -> DataFrame:
    """Replicas that differ from their key's latest value, beside the value they should hold.

    The latest time wins; equal times are settled by the larger value.
    """
    latest = replicas.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(value))).alias("_m")).select(
        key, F.col(f"_m.{ts}").alias("correct_ts"), F.col(f"_m.{value}").alias("correct_value"))
    return replicas.join(latest, key).filter(~F.col(value).eqNullSafe(F.col("correct_value"))
                                             | (F.col(ts) != F.col("correct_ts")))


def restore_snapshot(current: DataFrame, snapshot: DataFrame, key: str = "cache_key") -> DataFrame:
    """Keys of the snapshot take its rows, all others keep theirs."""
    return current.join(snapshot.select(key), key, "left_anti").unionByName(snapshot.select(*current.columns))


def full_snapshot(table: DataFrame, at: int) -> DataFrame:
    """All rows as the snapshot of time ``at``: the first link of a chain."""
    return table.withColumns({"snapshot_at": F.lit(at).cast("bigint"), "deleted": F.lit(False)})


def snapshot_increment(table: DataFrame, events: DataFrame, at: int, since: int, key: str = "cache_key") -> DataFrame:
    """The snapshot of time ``at`` of the keys written or deleted after ``since``, up to ``at``.

    A changed key that the table no longer holds leaves a tombstone (``deleted``), so a chain of increments
    forgets it as well. Nothing changed: no rows.
    """
    keys = changed_keys(events.filter(F.col("t") <= at), since).withColumnRenamed("cache_key", key)
    rows = full_snapshot(table, at).withColumn("_here", F.lit(True))
    return keys.join(rows, key, "left").select(
        *table.columns, F.lit(at).cast("bigint").alias("snapshot_at"), F.col("_here").isNull().alias("deleted"))


def restore_chain(snapshots: DataFrame, at: int, key: str = "cache_key") -> DataFrame:
    """The table at time ``at``: of every key the row of its last snapshot up to then, unless deleted.

    ``snapshots`` holds a full snapshot and the increments after it, in any order; later ones than ``at`` are
    not read where they are partitioned by ``snapshot_at``. Each task merges its own rows of a key first.
    """
    values = [c for c in snapshots.columns if c not in ("snapshot_at", "deleted")]
    last = snapshots.filter(F.col("snapshot_at") <= at).groupBy(key).agg(
        F.max_by(F.struct("deleted", *values), "snapshot_at").alias("_last"))
    return last.filter(~F.col("_last.deleted")).select(*[F.col(f"_last.{c}").alias(c) for c in values])


def changed_keys(events: DataFrame, since: int | Column | None = None) -> DataFrame:
    """Keys written or deleted after ``since``."""
    writes = events.filter(F.col("type").isin("SET", "DELETE") & F.col("cache_key").isNotNull())
    if since is not None:
        writes = writes.filter(F.col("t") > since)
    return writes.select("cache_key").distinct()


def incremental_snapshot(table: DataFrame, events: DataFrame, since: int | Column | None = None,
                         whole_if_unchanged: bool = True) -> DataFrame:
    """Rows of the changed keys; the whole table when nothing changed, or none without ``whole_if_unchanged``.

    Deleted keys are not in it: ``snapshot_increment`` keeps their tombstones.
    """
    keys = changed_keys(events, since)
    if not whole_if_unchanged:
        return table.join(keys, "cache_key", "left_semi")
    n = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    flagged = table.join(keys.withColumn("_changed", F.lit(True)), "cache_key", "left")
    return flagged.filter((n == 0) | F.col("_changed").isNotNull()).drop("_changed")


def expire_ttl(entries: DataFrame, now, written: str = "last_access", ttl: str = "ttl",
               zero_ttl: str = "never", inclusive: bool = True) -> DataFrame:
    """Entries still alive at ``now``; a NULL TTL never expires.

    ``inclusive`` drops an entry exactly at its expiry. ``zero_ttl`` is 'never' or 'now'.
    """
    end, now = F.col(written) + F.col(ttl), F.lit(now)
    gone = (now >= end) if inclusive else (now > end)
    gone = F.when(F.col(ttl) == 0, F.lit(zero_ttl == "now")).otherwise(gone)
    return entries.filter(~F.coalesce(gone, F.lit(False)))


def _newest(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order: every task keeps its own first ``n``, then those are merged."""
    return df.orderBy(*order).limit(n)


def trim_cache(entries: DataFrame, now, max_size: int = 1000, threshold: int = 800,
               expires: str = "expires_at", key: str = "cache_key") -> DataFrame:
    """Drop expired entries; when more than ``threshold`` are left keep the ``max_size`` that
    expire last."""
    live = entries.filter(F.col(expires) >= F.lit(now))
    n = live.agg(F.count(F.lit(1)).alias("n")).scalar()
    order = [F.desc(expires), F.desc(key)]
    kept = _newest(live, order, max_size)
    if max_size >= threshold:
        return kept
    # between the two sizes nothing is removed
    return kept.filter(n > threshold).unionByName(live.filter(n <= threshold))


_ORDERS = {
    "LRU": lambda: [F.asc("last_access"), F.asc("cache_key")],
    "LFU": lambda: [F.asc("access_count"), F.asc("cache_key")],
    "TTL": lambda: [F.coalesce("ttl", F.lit(0)).asc(), F.asc("cache_key")],
    "PRIORITY": lambda: [F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2)
                         .otherwise(3).asc(), F.asc("cache_key")],
}


def evict_to_budget(entries: DataFrame, strategy: str, max_bytes: int, max_items: int = 1_000_000,
                    keep_share: float | None = 0.7) -> DataFrame:
    """Entries to remove, in eviction order, once the table is over a limit.

    Nothing is removed below both limits. Otherwise entries go in the strategy's order until the
    kept size is at most ``keep_share`` of ``max_bytes``; ``keep_share=None`` removes every entry.
    """
    size = entries.agg(F.struct(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    total, items = size["b"], size["n"]
    over = (total >= max_bytes) | (items >= max_items)
    summed = running_total(entries, _ORDERS[strategy](), F.col("size_bytes"), "_freed")
    if keep_share is None:
        return summed.filter(over).withColumnRenamed("_freed", "freed_bytes")
    # an entry goes while the entries before it have not freed enough
    needed = total - F.lit(int(max_bytes * keep_share))
    return summed.filter(over & (F.col("_freed") - F.col("size_bytes") < needed)) \
        .withColumnRenamed("_freed", "freed_bytes")


def cap_tiers(keys: DataFrame, max_high: int = 1000, max_medium: int = 5000,
              order: str = "last_access", key: str = "cache_key") -> DataFrame:
    """Tier after the caps: the newest HIGH keys stay, the rest joins MEDIUM, whose newest stay,
    everything else is LOW.

    Each tier keeps a bounded number of keys, found by a sorted limit and joined back.
    """
    newest = [F.desc(order), F.desc(key)]
    high = _newest(keys.filter("priority = 'HIGH'"), newest, max_high).select(key)
    marked = keys.join(high.withColumn("_high", F.lit(True)), key, "left")
    open_ = marked.filter(F.col("_high").isNull() & F.col("priority").isin("HIGH", "MEDIUM"))
    medium = _newest(open_.select(key, order), newest, max_medium).select(key)
    out = marked.join(medium.withColumn("_medium", F.lit(True)), key, "left")
    tier = F.when(F.col("_high"), "HIGH").when(F.col("_medium"), "MEDIUM").otherwise("LOW")
    return out.withColumn("tier", tier).drop("_high", "_medium")


def keep_last_n(df: DataFrame, n: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, or the newest ``n`` per group."""
    if by:
        return first_rows(df, list(by), [F.desc(order)], n)
    return _newest(df, [F.desc(order)], n)


def tier_counts(df: DataFrame, col: str = "priority") -> DataFrame:
    """Items per priority tier (tiers without items included) and in all."""
    return df.agg(F.count(F.lit(1)).alias("total_items"),
                  *[F.count_if(F.col(col) == t).alias(f"{t.lower()}_priority") for t in ("HIGH", "MEDIUM", "LOW")])


def task_status(tasks: DataFrame) -> DataFrame:
    """Tasks per status and the mean progress, 0 without tasks."""
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "in_progress")],
        F.coalesce(F.avg("progress"), F.lit(0.0)).alias("total_progress"))
