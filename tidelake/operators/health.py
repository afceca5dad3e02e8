"""Health, lag, gaps and state changes of the catalog, as rules over its tables at an instant `as_of` (milliseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_APPLY_S, STALE_CAPTURE_S = 900, 300
LAG_WARN, LAG_CRITICAL = 1_000, 50_000
STICKY = ("quarantined", "failed", "gap_detected")


def age_s(ms: Column, as_of: int) -> Column:
    """Whole seconds since a time, not below 0; null stays null."""
    return F.when(ms.isNotNull(), F.greatest(F.floor((F.lit(as_of) - ms) / 1000), F.lit(0)))


def apply_position_health(positions: DataFrame, catalog: DataFrame, as_of: int, stale_s: int = STALE_APPLY_S) -> DataFrame:
    """Positions of tables that apply runs for, with lag and status: sticky states stay, late ones are stale or lagging,
    those that caught up are healthy again."""
    live = catalog.where(F.col("active") & F.col("cdc_enabled") & ~F.col("needs_full_load")).select("catalog_id")
    rows = positions.join(live, "catalog_id", "left_semi")
    lag, status = age_s(F.col("last_applied_ms"), as_of), F.col("status")
    now = F.when(status.isin(*STICKY) | lag.isNull(), status).when(lag > stale_s, "stale").when(lag > max(1, stale_s // 2), "lagging").when(status.isin("stale", "lagging"), "healthy").otherwise(status)
    return rows.withColumns({"apply_lag_seconds": F.coalesce(lag, F.lit(0)).cast("int"), "status": now})


def capture_position_health(capture: DataFrame, as_of: int, stale_s: int = STALE_CAPTURE_S) -> DataFrame:
    """Capture positions that were ever updated; the lag of sticky and stale ones is frozen."""
    status, idle = F.col("status"), age_s(F.col("updated_ms"), as_of)
    sticky = status.isin(*STICKY)
    lag = age_s(F.coalesce("last_event_ms", "updated_ms"), as_of).cast("int")
    now = F.when(sticky, status).when(idle > stale_s, "stale").when(status == "stale", "healthy").otherwise(status)
    held = sticky | (idle > stale_s) | (status == "stale")
    return capture.where(F.col("updated_ms").isNotNull()).withColumns({"capture_lag_seconds": F.when(held, F.col("capture_lag_seconds")).otherwise(lag), "status": now})


def lag_severity(lag: Column, inactive: Column) -> Column:
    return F.when(inactive | (lag <= 0), "none").when(lag >= LAG_CRITICAL, "critical").when(lag >= LAG_WARN, "warn").otherwise("none")


def event_loss(parse_skipped: Column, dropped: Column) -> Column:
    return F.when(dropped > 0, "fail").when(parse_skipped > 0, "warn").otherwise("ok")


def rag(stale: Column, quarantined: Column, status: Column, loss: Column, severity: Column) -> Column:
    """Health colour: what stops a table is red, what delays it amber."""
    s = F.coalesce(status, F.lit(""))
    return F.when(quarantined | s.isin(*STICKY) | (loss == "fail") | (severity == "critical"), "RED").when(stale | s.isin("stale", "lagging") | (loss == "warn") | (severity == "warn"), "AMBER").when(s.isin("healthy", "ok", ""), "GREEN").otherwise("UNKNOWN")


def reason(stale: Column, quarantined: Column, status: Column, loss: Column, severity: Column, capture_lag: Column, inactive: Column) -> Column:
    """The first reason that holds, gravest first."""
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(quarantined | (s == "quarantined"), "apply_quarantined")
        .when(s.isin("failed", "gap_detected"), F.concat(F.lit("apply_"), s))
        .when(loss == "fail", "event_loss_unrecoverable")
        .when(loss == "warn", "parse_skipped")
        .when(stale | s.isin("stale", "lagging"), "apply_stale")
        .when(severity == "critical", "kafka_backlog_critical")
        .when(severity == "warn", "kafka_backlog")
        .when(F.coalesce(capture_lag > 300, F.lit(False)), "capture_lag_high")
        .when(inactive, "slice_quiet")
        .otherwise("healthy")
    )


def snapshot(catalog: DataFrame, positions: DataFrame, capture: DataFrame, as_of: int) -> DataFrame:
    """Each table's apply and capture lag and state; engines that capture by table have no lag of their connection."""
    p = positions.select("catalog_id", F.col("status").alias("apply_status"), "last_applied_ms")
    c = capture.select("conn_id", F.col("status").alias("capture_status"), "capture_lag_seconds")
    rows = catalog.join(p, "catalog_id", "left").join(c, "conn_id", "left")
    return rows.select("catalog_id", "active", "cdc_enabled", "apply_status", F.coalesce(age_s(F.col("last_applied_ms"), as_of), F.lit(-1)).alias("seconds_since_last_apply"), F.when(F.col("db_engine") == "mariadb", F.coalesce("capture_lag_seconds", F.lit(0))).otherwise(0).alias("capture_lag_seconds"), F.coalesce(F.col("apply_status") == "quarantined", F.lit(False)).alias("is_quarantined"))


def partition_lag(consumed: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages behind the log's end: 0 for an empty partition, -1 where nothing is known of the consumer."""
    rows = ends.join(consumed.groupBy("topic", "part").agg(F.max("pos").alias("consumed")), ["topic", "part"], "left")
    return rows.withColumn("lag", F.when(F.col("end") == 0, 0).when(F.col("consumed").isNull(), -1).otherwise(F.greatest(F.col("end") - F.col("consumed") - 1, F.lit(0))))


def gap_kind(detail: Column) -> Column:
    has = lambda w: F.contains(detail, F.lit(w))
    return F.when(has("server_uuid"), "server_uuid_changed").when(has("lsn purged") | has("mssql cdc"), "mssql_lsn_purged").when(has("offset") | has("Offset"), "kafka_offset_lost").otherwise("binlog_purged")


def offsets_lost(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """Tables whose place the log no longer holds, with what is lost."""
    rows = positions.join(starts, (positions["kafka_topic"] == starts["topic"]) & (positions["kafka_partition"] == starts["part"]))
    return rows.where(F.col("kafka_offset") < F.col("start")).select("catalog_id", "conn_id", F.lit("kafka_offset_lost").alias("gap_kind"), (F.col("start") - F.col("kafka_offset")).alias("lost"))


def gap_sweep(catalog: DataFrame, positions: DataFrame, capture: DataFrame) -> DataFrame:
    """Active tables to load again because their own or their connection's position has a gap."""
    own = positions.where("status = 'gap_detected'").select("catalog_id", F.lit("apply").alias("side"))
    conn = capture.where("status = 'gap_detected'").select("conn_id")
    by_conn = catalog.join(conn, "conn_id", "left_semi").select("catalog_id", F.lit("capture").alias("side"))
    return own.unionByName(by_conn).distinct().join(catalog.where("active").select("catalog_id", "conn_id"), "catalog_id")


def gap_resolve(gaps: DataFrame, positions: DataFrame, capture: DataFrame) -> DataFrame:
    """Open gaps that may be closed: an apply gap once its table is healthy, a capture gap once its connection is."""
    open_ = gaps.where("resolved_ms is null")
    tables = positions.where("status = 'healthy'").select("catalog_id")
    conns = capture.where("status = 'healthy'").select("conn_id")
    return open_.where("gap_side = 'apply'").join(tables, "catalog_id", "left_semi").select("gap_id").unionByName(open_.where("gap_side = 'capture'").join(conns, "conn_id", "left_semi").select("gap_id"))


def clear_stale(catalog: DataFrame, as_of: int, after_s: int = 300) -> DataFrame:
    """Tables left in progress too long: pending if they wait for a load, else success."""
    stuck = (F.col("status") == "cdc_in_progress") & (F.coalesce("updated_ms", F.lit(0)) < as_of - after_s * 1000)
    return catalog.withColumn("status", F.when(stuck, F.when(F.col("needs_full_load"), "pending").otherwise("success")).otherwise(F.col("status")))


def transition(catalog: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Catalog after outcomes (catalog_id, outcome, message): cdc_start, cdc_success, cdc_failure, load_start, load_ready, skipped."""
    rows = catalog.join(outcomes, "catalog_id", "left")
    o = F.col("outcome")
    status = F.when(o == "cdc_start", "cdc_in_progress").when(o == "cdc_success", "success").when(o == "cdc_failure", "error").when(o == "load_start", "full_load_in_progress").when(o == "load_ready", "pending").when(o == "skipped", "skipped").otherwise(F.col("status"))
    error = F.when(o.isin("cdc_failure", "skipped"), F.col("message")).when(o.isin("cdc_success", "load_ready"), F.lit(None)).otherwise(F.col("last_error"))
    load = F.when(o == "load_ready", False).otherwise(F.col("needs_full_load"))
    return rows.withColumns({"status": status, "last_error": error, "needs_full_load": load}).drop("outcome", "message")


def load_retry(catalog: DataFrame, as_of: int, most: int = 5, cooldown_min: int = 240) -> DataFrame:
    """Tables whose load failed: one failure more; at the limit loading stops until the cooldown is over."""
    n = F.col("load_failures") + 1
    cool = F.col("last_error_ms") <= as_of - cooldown_min * 60_000
    return catalog.where("status = 'error'").select("catalog_id", F.when((n >= most) & cool, 0).otherwise(n).alias("load_failures"), ((n < most) | cool).alias("needs_full_load"), F.when((n >= most) & ~cool, F.concat("last_error", F.lit(" (stopped)"))).otherwise(F.col("last_error")).alias("last_error"))


def stale_checkpoints(checkpoints: DataFrame, catalog: DataFrame, as_of: int, minutes: int = 60) -> tuple[DataFrame, DataFrame]:
    """(checkpoints that stay, tables set back to pending): copies of loads that are over, ended or too old go."""
    c = catalog.select("catalog_id", "needs_full_load", F.col("status").alias("table_status"))
    over = checkpoints.where("phase = 'copy'").join(c, "catalog_id").where(~F.col("needs_full_load") | F.col("table_status").isin("skipped", "disabled", "quarantined") | (F.col("updated_ms") < as_of - minutes * 60_000)).select("catalog_id", "worker_id")
    return checkpoints.join(over, ["catalog_id", "worker_id"], "left_anti"), catalog.where("status = 'full_load_in_progress'").join(over, "catalog_id", "left_semi").select("catalog_id")


def resume_loads(catalog: DataFrame, checkpoints: DataFrame, as_of: int, stale_min: int = 120) -> DataFrame:
    """Loads under way that are to start over: those with a copy to resume, and those without a sign of life."""
    running = catalog.where("status = 'full_load_in_progress'")
    copies = checkpoints.where("phase = 'copy'").select("catalog_id").distinct().withColumn("has_copy", F.lit(True))
    rows = running.join(copies, "catalog_id", "left")
    return rows.where(F.coalesce("has_copy", F.lit(False)) | (F.coalesce("updated_ms", F.lit(0)) < as_of - stale_min * 60_000)).select("catalog_id", F.lit("pending").alias("status"))


def set_mode(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Catalog after requests (catalog_id, request): enable, disable, scd2_on, scd2_off, reload."""
    r = F.col("request")
    rows = catalog.join(requests, "catalog_id", "left")
    on = F.when(r == "enable", True).when(r == "disable", False)
    return rows.withColumns({"active": F.coalesce(on, F.col("active")), "cdc_enabled": F.coalesce(on, F.col("cdc_enabled")), "scd2_enabled": F.when(r == "scd2_on", True).when(r == "scd2_off", False).otherwise(F.col("scd2_enabled")), "needs_full_load": F.when(r == "reload", True).otherwise(F.col("needs_full_load"))}).drop("request")


def seed_positions(eligible: DataFrame, positions: DataFrame, name: tuple[str, ...] = ("conn_id", "source_schema", "source_table")) -> DataFrame:
    """Positions with one more for each eligible table whose id has none. A table has one position: where its id has
    changed, the new one takes the place of that of the older id; of several new ids the highest stays."""
    columns = ["catalog_id", *name]
    missing = eligible.select(*columns).join(positions.select("catalog_id"), "catalog_id", "left_anti")
    new = missing.groupBy(*name).agg(F.max("catalog_id").alias("catalog_id")).select(*columns)
    left = positions.select(*columns, "status").join(new.select(*name), list(name), "left_anti").select(*columns, "status")
    return left.unionByName(new.withColumn("status", F.lit("healthy")))


def pending_counts(catalog: DataFrame) -> DataFrame:
    return catalog.where("active").groupBy("conn_id").agg(F.count_if(F.col("needs_full_load")).alias("waiting_load"), F.count_if(~F.col("needs_full_load") & ~F.col("cdc_enabled")).alias("waiting_onboard"))


def unquarantine(positions: DataFrame, ids: DataFrame) -> DataFrame:
    """Positions after a release: healthy, without a reason, and to be replayed."""
    rows = positions.join(ids.select("catalog_id", F.lit(True).alias("_free")).distinct(), "catalog_id", "left")
    hit = F.coalesce("_free", F.lit(False)) & (F.col("status") == "quarantined")
    return rows.withColumns({"status": F.when(hit, "healthy").otherwise(F.col("status")), "quarantine_reason": F.when(hit, F.lit(None)).otherwise(F.col("quarantine_reason")), "replay_requested": hit | F.col("replay_requested")}).drop("_free")
