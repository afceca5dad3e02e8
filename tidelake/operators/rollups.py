"""Roll-ups and monitoring queries over the pipeline's bookkeeping tables.

Times are milliseconds since 1970 and every rule that looks at the clock takes `as_of`, so results repeat. The latest
row of a table is found by a partial and a final max_by on small structs, never by a sort of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def since(col: str, as_of: int, span: int) -> Column:
    return F.col(col) >= as_of - span


def hour(col: str = "logged_ms") -> Column:
    return (F.floor(F.col(col) / HOUR) * HOUR).alias("hour_ms")


def flag(c: Column) -> Column:
    """1 where true, else 0."""
    return F.when(c, 1).otherwise(0)


def latest_stats(stats: DataFrame, as_of: int, span: int = 3 * DAY, key: str = "catalog_id") -> DataFrame:
    """The newest row of each table within the span; of equal times the larger stat_id."""
    cols = [c for c in stats.columns if c != key]
    newest = stats.where(since("logged_ms", as_of, span)).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("logged_ms", "stat_id")).alias("s"))
    return newest.select(key, "s.*")


def health_latest(stats: DataFrame, catalog: DataFrame, as_of: int) -> DataFrame:
    """Latest stats of each cataloged table, with flags."""
    rows = latest_stats(stats, as_of).join(catalog.select("catalog_id", "db_engine"), "catalog_id")
    rag = F.col("apply_health_rag")
    return rows.withColumns({"is_green": flag(rag == "GREEN"), "is_amber": flag(rag == "AMBER"), "is_red": flag(rag == "RED"), "is_event_loss": flag(F.col("event_loss_status") != "ok"), "lag_active": flag(F.coalesce("kafka_consumer_lag", F.lit(0)) > 0), "table_fqn": F.concat_ws(".", "source_schema", "source_table")})


def catalog_overview(catalog: DataFrame, positions: DataFrame) -> DataFrame:
    """Catalog rows with their apply position and readiness flags."""
    p = positions.select("catalog_id", F.col("status").alias("apply_status"), "apply_lag_seconds", "quarantine_reason", F.left("last_error", F.lit(120)).alias("last_error_short"))
    rows = catalog.drop("last_error").join(p, "catalog_id", "left")
    ready = F.col("active") & F.col("cdc_enabled") & ~F.col("needs_full_load")
    held = (F.col("status") == "quarantined") | F.coalesce(F.col("apply_status") == "quarantined", F.lit(False))
    return rows.withColumns({"event_ms": F.coalesce("updated_ms", "discovered_ms"), "is_cdc_ready": flag(ready), "is_quarantined": flag(held), "is_success": flag(F.col("status") == "success"), "is_pending": flag(F.col("status") == "pending")})


def capture_overview(capture: DataFrame) -> DataFrame:
    return capture.select("conn_id", F.col("status").alias("capture_status"), "capture_lag_seconds", F.left(F.coalesce("last_error", F.lit("")), F.lit(120)).alias("last_error_short"), flag(F.col("status") != "healthy").alias("is_unhealthy"))


def events_hourly(stats: DataFrame, catalog: DataFrame, as_of: int) -> DataFrame:
    joined = stats.where(since("logged_ms", as_of, 3 * DAY)).join(catalog.select("catalog_id", "db_engine"), "catalog_id")
    sums = [F.sum(c).alias(c) for c in ("events_total", "events_inserts", "events_updates", "events_deletes", "events_seen_in_slice")]
    return joined.groupBy(hour(), "conn_id", "db_engine").agg(*sums, F.round(F.avg("duration_ms")).cast("long").alias("duration_ms_avg"), F.max("kafka_consumer_lag").alias("kafka_consumer_lag_max"))


def kafka_hourly(stats: DataFrame, as_of: int) -> DataFrame:
    return stats.where(since("logged_ms", as_of, 3 * DAY)).groupBy(hour(), "conn_id").agg(F.max("kafka_consumer_lag").alias("kafka_consumer_lag_max"), F.max("kafka_partition_lag").alias("kafka_partition_lag_max"), F.round(F.avg("apply_lag_seconds")).cast("int").alias("apply_lag_seconds_avg"), F.round(F.avg("capture_lag_seconds")).cast("int").alias("capture_lag_seconds_avg"))


def logs_hourly(logs: DataFrame, as_of: int) -> DataFrame:
    by = [F.count_if(F.col("level") == x).alias(f"{x}_count") for x in ("error", "warning", "info")]
    return logs.where(since("logged_ms", as_of, 3 * DAY)).groupBy(hour(), "component", "level").agg(F.count("*").alias("row_count"), *by, F.max("logged_ms").alias("last_logged_ms"))


def kpis(connections: DataFrame, catalog: DataFrame, stats: DataFrame, logs: DataFrame, capture: DataFrame, dlq: DataFrame, as_of: int) -> DataFrame:
    """One row of headline figures; each table is read once and reduced to one row before the rows are put together."""
    day = as_of - DAY
    latest = latest_stats(stats, as_of)
    c = catalog.where("active")
    parts = [
        connections.agg(F.count_if("active").alias("connections")),
        c.agg(F.count_if(F.col("cdc_enabled") & ~F.col("needs_full_load")).alias("cdc_ready"), F.count_if(F.col("status") == "cdc_in_progress").alias("cdc_in_progress"), F.count_if("needs_full_load").alias("needs_full_load"), F.count_if(F.col("status") == "quarantined").alias("quarantined_tables")),
        latest.agg(*[F.count_if(F.col("apply_health_rag") == x.upper()).alias(f"apply_{x}") for x in ("green", "amber", "red")], F.count_if(F.col("event_loss_status") != "ok").alias("event_loss_tables")),
        logs.agg(F.count_if((F.col("level") == "error") & (F.col("logged_ms") > day)).alias("errors_24h")),
        latest_stats(stats, as_of, HOUR, "conn_id").agg(F.coalesce(F.sum("kafka_consumer_lag"), F.lit(0)).alias("total_kafka_lag")),
        stats.agg(*[F.coalesce(F.sum(F.when(F.col("logged_ms") >= day, F.col(x))), F.lit(0)).alias(f"{x}_24h") for x in ("dropped_unrecoverable", "parse_skipped", "dedup_skipped")], F.coalesce(F.floor((as_of - F.max("logged_ms")) / 1000), F.lit(-1)).alias("seconds_since_last_slice")),
        capture.agg(F.count_if(F.col("status") != "healthy").alias("capture_unhealthy"), F.coalesce(F.max("capture_lag_seconds"), F.lit(0)).alias("max_capture_lag")),
        dlq.agg(F.count_if(F.col("status") == "parked").alias("dlq_parked")),
    ]
    out = parts[0]
    for p in parts[1:]:  # rows of one
        out = out.join(F.broadcast(p))
    return out


def events_by_connection(stats: DataFrame, as_of: int) -> DataFrame:
    return stats.where(since("logged_ms", as_of, 3 * DAY)).groupBy(hour(), "conn_id").agg(*[F.sum(c).alias(c) for c in ("events_total", "events_inserts", "events_updates", "events_deletes")])


def count_active(catalog: DataFrame, by: str) -> DataFrame:
    return catalog.where("active").groupBy(by).agg(F.count("*").alias("count"))


def newest(rows: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The n newest rows, as a top-k."""
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n)


def errors_by_component(logs: DataFrame, as_of: int, n: int = 12) -> DataFrame:
    found = logs.where((F.col("level") == "error") & (F.col("logged_ms") > as_of - DAY)).groupBy("component").agg(F.count("*").alias("error_count"))
    return found.orderBy(F.desc("error_count"), "component").limit(n)


def pipeline_tables(catalog: DataFrame, stats: DataFrame, positions: DataFrame, capture: DataFrame, as_of: int) -> DataFrame:
    """Active tables with event sums of a day and of five minutes and their latest lag: one conditional aggregate."""
    recent = F.col("logged_ms") >= as_of - 5 * MINUTE
    sums = [F.sum(F.when(recent, F.col(c))).alias(f"{c}_5m") for c in ("events_total", "events_inserts", "events_updates", "events_deletes")]
    per = stats.groupBy("catalog_id").agg(F.sum(F.when(F.col("logged_ms") >= as_of - DAY, F.col("events_total"))).alias("events_24h"), *sums, F.max_by("kafka_consumer_lag", F.struct("logged_ms", "stat_id")).alias("kafka_consumer_lag"))
    zero = ["events_24h", "events_total_5m", "events_inserts_5m", "events_updates_5m", "events_deletes_5m", "kafka_consumer_lag"]
    rows = catalog.where("active").join(per, "catalog_id", "left").fillna(0, zero)
    rows = rows.join(capture.select("conn_id", F.col("status").alias("capture_status"), "capture_lag_seconds"), "conn_id", "left")
    return rows.join(positions.select("catalog_id", "apply_lag_seconds", "kafka_partition"), "catalog_id", "left").select("catalog_id", "conn_id", "db_engine", "status", *zero, "capture_status", "capture_lag_seconds", "apply_lag_seconds", "kafka_partition")


def duration_hourly(stats: DataFrame, as_of: int) -> DataFrame:
    return stats.where(since("logged_ms", as_of, 3 * DAY)).groupBy(hour()).agg(F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"))


def event_loss_mix(stats: DataFrame, as_of: int) -> DataFrame:
    return latest_stats(stats, as_of).groupBy(F.col("event_loss_status").alias("status")).agg(F.count("*").alias("count"))


def top_lag(stats: DataFrame, as_of: int, n: int = 12) -> DataFrame:
    return latest_stats(stats, as_of).where("kafka_consumer_lag > 0").orderBy(F.desc("kafka_consumer_lag"), "catalog_id").limit(n).select("catalog_id", "conn_id", "kafka_consumer_lag", "apply_health_rag")


def enriched_catalog(catalog: DataFrame, stats: DataFrame, positions: DataFrame, as_of: int) -> DataFrame:
    """Active tables with a resolved health colour: quarantined or failed states first, then the latest stats'."""
    s = latest_stats(stats, as_of).select("catalog_id", "apply_health_rag")
    rows = catalog.where("active").join(positions.select("catalog_id", F.col("status").alias("apply_status")), "catalog_id", "left").join(s, "catalog_id", "left")
    held = (F.col("status") == "quarantined") | F.coalesce(F.col("apply_status") == "quarantined", F.lit(False))
    rag = F.when(held | F.col("status").isin("error", "failed"), "RED").when(F.col("apply_health_rag").isNotNull(), F.col("apply_health_rag")).when(F.col("needs_full_load"), "AMBER").otherwise("UNKNOWN")
    rank = F.when(F.col("health_rag") == "RED", 0).when(F.col("health_rag") == "AMBER", 1).when(F.col("health_rag") == "UNKNOWN", 2).otherwise(3)
    return rows.withColumns({"quarantined": held, "health_rag": rag}).withColumn("rag_rank", rank)


def catalog_page(rows: DataFrame, text: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the enriched catalog, worst first, with the number of all matches on each row."""
    if text:
        rows = rows.where(F.col("source_schema").ilike(f"%{text}%") | F.col("source_table").ilike(f"%{text}%"))
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).orderBy("rag_rank", "conn_id", "source_schema", "catalog_id").offset(offset).limit(limit).select("catalog_id", "conn_id", "health_rag", "quarantined", "total")


def overview_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("tables_active"), F.count_if("cdc_enabled").alias("tables_cdc"), *[F.count_if(F.col("health_rag") == x.upper()).alias(f"rag_{x}") for x in ("red", "amber", "green")], F.count_if("quarantined").alias("quarantined"), F.count_if("needs_full_load").alias("needs_full_load"))


def overview_queue(rows: DataFrame, limit: int = 50) -> DataFrame:
    wanted = F.col("health_rag").isin("RED", "AMBER") | F.col("quarantined") | F.col("needs_full_load") | F.col("status").isin("error", "full_load_in_progress", "pending", "needs_full_load")
    rank = F.when(F.col("health_rag") == "RED", 0).when(F.col("health_rag") == "AMBER", 1).otherwise(2)
    return rows.where(wanted).orderBy(rank, "conn_id", "source_schema", "catalog_id").limit(limit).select("catalog_id", "conn_id", "health_rag", "status")


def last_per_table(rows: DataFrame, time: str, key: str, n: int = 5) -> DataFrame:
    """The n newest rows of each table. Each task keeps n of a table before any shuffle of the rest."""
    from pyspark.sql import Window

    w = Window.partitionBy("catalog_id").orderBy(F.desc(time), F.desc(key))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def connection_summary(catalog: DataFrame) -> DataFrame:
    ready = F.col("active") & F.col("cdc_enabled") & ~F.col("needs_full_load")
    return catalog.groupBy("conn_id").agg(F.count("*").alias("tables_total"), F.count_if("active").alias("tables_active"), F.count_if(ready).alias("cdc_ready"), F.count_if("needs_full_load").alias("needs_full_load"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status").isin("error", "failed")).alias("failed"))


def connection_hourly(stats: DataFrame, as_of: int) -> DataFrame:
    return stats.where(since("logged_ms", as_of, DAY)).groupBy("conn_id", hour()).agg(F.coalesce(F.sum("events_total"), F.lit(0)).alias("events"), F.coalesce(F.max("kafka_consumer_lag"), F.lit(0)).alias("kafka_lag"), F.round(F.coalesce(F.avg("apply_lag_seconds"), F.lit(0.0))).cast("int").alias("apply_lag"))


def connection_recent(connections: DataFrame, stats: DataFrame, as_of: int) -> DataFrame:
    recent = stats.where(since("logged_ms", as_of, 5 * MINUTE)).groupBy(F.col("conn_id").alias("alias")).agg(F.sum("events_total").alias("events_5m"))
    return connections.select("alias").join(recent, "alias", "left").fillna(0, ["events_5m"])


def pipeline_ok(catalog: DataFrame, stats: DataFrame, as_of: int) -> DataFrame:
    a = catalog.where("active").agg(F.count_if("needs_full_load").alias("pending_load"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))
    red = latest_stats(stats, as_of).agg(F.count_if(F.col("apply_health_rag") == "RED").alias("red"))
    return a.join(F.broadcast(red)).withColumn("ok", (F.col("pending_load") == 0) & (F.col("quarantined") == 0) & (F.col("red") == 0))


def page_with_total(rows: DataFrame, time: str, key: str, offset: int, limit: int) -> DataFrame:
    """A newest-first page with the number of all rows on each."""
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(F.desc(time), F.desc(key)).offset(offset).limit(limit)


def capture_branches(catalog: DataFrame) -> DataFrame:
    """Tables of each connection on the main branch and on the one that streams during a load."""
    eligible = catalog.where(F.col("active") & F.col("cdc_enabled") & F.col("has_pk"))
    return eligible.groupBy("conn_id").agg(F.count_if(~F.col("needs_full_load")).alias("main_tables"), F.count_if(F.col("needs_full_load") & F.col("capture_during_full_load")).alias("stream_tables"))


def retain(rows: DataFrame, time: str, as_of: int, days: int) -> DataFrame:
    """Rows of the last days, one at least."""
    return rows.where(since(time, as_of, max(days, 1) * DAY))


def retain_active(stats: DataFrame) -> DataFrame:
    """Stats without idle rows: inactive ones, and those that saw and applied nothing."""
    idle = F.coalesce("is_inactive", F.lit(False)) | ((F.coalesce("events_total", F.lit(0)) == 0) & (F.coalesce("events_seen_in_slice", F.lit(0)) == 0))
    return stats.where(~idle)


def retain_dlq(dlq: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """Parked rows always, resolved ones for some days."""
    return dlq.where((F.col("status") == "parked") | (F.coalesce("resolved_ms", "logged_ms") >= as_of - days * DAY))
