"""Roll-ups and monitoring queries."""

from pyspark.sql import functions as F

from ..operators import rollups as r
from .registry import AS_OF, query

#: The newest row of each table within three days, for the oracles.
LATEST = "SELECT * FROM stats WHERE logged_ms >= {as_of} - 259200000 QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY logged_ms DESC, stat_id DESC) = 1"
HOUR = "CAST(floor(logged_ms / 3600000) AS BIGINT) * 3600000 AS hour_ms"


@query("mv_health_latest", f"SELECT l.catalog_id, l.stat_id, l.logged_ms, c.db_engine, CAST(l.apply_health_rag = 'GREEN' AS INT) AS is_green, CAST(l.apply_health_rag = 'AMBER' AS INT) AS is_amber, CAST(l.apply_health_rag = 'RED' AS INT) AS is_red, CAST(l.event_loss_status <> 'ok' AS INT) AS is_event_loss, CAST(l.kafka_consumer_lag > 0 AS INT) AS lag_active, l.source_schema || '.' || l.source_table AS table_fqn FROM ({LATEST}) l JOIN catalog c ON c.catalog_id = l.catalog_id")
def _(t):
    return r.health_latest(t.stats, t.catalog, AS_OF).select("catalog_id", "stat_id", "logged_ms", "db_engine", "is_green", "is_amber", "is_red", "is_event_loss", "lag_active", "table_fqn")


@query("mv_catalog", "SELECT c.catalog_id, c.status, p.status AS apply_status, p.apply_lag_seconds, left(p.last_error, 120) AS last_error_short, coalesce(c.updated_ms, c.discovered_ms) AS event_ms, CAST(c.active AND c.cdc_enabled AND NOT c.needs_full_load AS INT) AS is_cdc_ready, CAST(c.status = 'quarantined' OR coalesce(p.status = 'quarantined', false) AS INT) AS is_quarantined, CAST(c.status = 'success' AS INT) AS is_success, CAST(c.status = 'pending' AS INT) AS is_pending FROM catalog c LEFT JOIN apply_position p ON p.catalog_id = c.catalog_id")
def _(t):
    return r.catalog_overview(t.catalog, t.apply_position).select("catalog_id", "status", "apply_status", "apply_lag_seconds", "last_error_short", "event_ms", "is_cdc_ready", "is_quarantined", "is_success", "is_pending")


CAPTURE = "SELECT conn_id, status AS capture_status, capture_lag_seconds, left(coalesce(last_error, ''), 120) AS last_error_short, CAST(status <> 'healthy' AS INT) AS is_unhealthy FROM capture_position"


@query("mv_capture_latest", CAPTURE)
def _(t):
    return r.capture_overview(t.capture_position)


@query("mv_events_hourly", f"SELECT {HOUR}, s.conn_id, c.db_engine, sum(events_total)::BIGINT AS events_total, sum(events_inserts)::BIGINT AS events_inserts, sum(events_updates)::BIGINT AS events_updates, sum(events_deletes)::BIGINT AS events_deletes, sum(events_seen_in_slice)::BIGINT AS events_seen_in_slice, round(avg(duration_ms))::BIGINT AS duration_ms_avg, max(kafka_consumer_lag) AS kafka_consumer_lag_max FROM stats s JOIN catalog c ON c.catalog_id = s.catalog_id WHERE logged_ms >= {{as_of}} - 259200000 GROUP BY 1, 2, 3")
def _(t):
    return r.events_hourly(t.stats, t.catalog, AS_OF)


@query("mv_kafka_hourly", f"SELECT {HOUR}, conn_id, max(kafka_consumer_lag) AS kafka_consumer_lag_max, max(kafka_partition_lag) AS kafka_partition_lag_max, round(avg(apply_lag_seconds))::INT AS apply_lag_seconds_avg, round(avg(capture_lag_seconds))::INT AS capture_lag_seconds_avg FROM stats WHERE logged_ms >= {{as_of}} - 259200000 GROUP BY 1, 2")
def _(t):
    return r.kafka_hourly(t.stats, AS_OF)


@query("mv_logs_hourly", f"SELECT {HOUR}, component, level, count(*) AS row_count, count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warning') AS warning_count, count(*) FILTER (level = 'info') AS info_count, max(logged_ms) AS last_logged_ms FROM logs WHERE logged_ms >= {{as_of}} - 259200000 GROUP BY 1, 2, 3")
def _(t):
    return r.logs_hourly(t.logs, AS_OF)


@query(
    "ops_kpis",
    f"""SELECT (SELECT count(*) FROM connections WHERE active) AS connections,
  (SELECT count(*) FROM catalog WHERE active AND cdc_enabled AND NOT needs_full_load) AS cdc_ready,
  (SELECT count(*) FROM catalog WHERE active AND status = 'cdc_in_progress') AS cdc_in_progress,
  (SELECT count(*) FROM catalog WHERE active AND needs_full_load) AS needs_full_load,
  (SELECT count(*) FROM catalog WHERE active AND status = 'quarantined') AS quarantined_tables,
  (SELECT count(*) FROM ({LATEST}) WHERE apply_health_rag = 'GREEN') AS apply_green,
  (SELECT count(*) FROM ({LATEST}) WHERE apply_health_rag = 'AMBER') AS apply_amber,
  (SELECT count(*) FROM ({LATEST}) WHERE apply_health_rag = 'RED') AS apply_red,
  (SELECT count(*) FROM ({LATEST}) WHERE event_loss_status <> 'ok') AS event_loss_tables,
  (SELECT count(*) FROM logs WHERE level = 'error' AND logged_ms > {{as_of}} - 86400000) AS errors_24h,
  (SELECT coalesce(sum(kafka_consumer_lag), 0)::BIGINT FROM (SELECT * FROM stats WHERE logged_ms >= {{as_of}} - 3600000 QUALIFY row_number() OVER (PARTITION BY conn_id ORDER BY logged_ms DESC, stat_id DESC) = 1)) AS total_kafka_lag,
  (SELECT sum(dropped_unrecoverable)::BIGINT FROM stats WHERE logged_ms >= {{as_of}} - 86400000) AS dropped_unrecoverable_24h,
  (SELECT sum(parse_skipped)::BIGINT FROM stats WHERE logged_ms >= {{as_of}} - 86400000) AS parse_skipped_24h,
  (SELECT sum(dedup_skipped)::BIGINT FROM stats WHERE logged_ms >= {{as_of}} - 86400000) AS dedup_skipped_24h,
  (SELECT CAST(floor(({{as_of}} - max(logged_ms)) / 1000) AS BIGINT) FROM stats) AS seconds_since_last_slice,
  (SELECT count(*) FROM capture_position WHERE status <> 'healthy') AS capture_unhealthy,
  (SELECT max(capture_lag_seconds) FROM capture_position) AS max_capture_lag,
  (SELECT count(*) FROM dlq WHERE status = 'parked') AS dlq_parked""",
)
def _(t):
    return r.kpis(t.connections, t.catalog, t.stats, t.logs, t.capture_position, t.dlq, AS_OF)


@query("ops_events_hourly", f"SELECT {HOUR}, conn_id, sum(events_total)::BIGINT AS events_total, sum(events_inserts)::BIGINT AS events_inserts, sum(events_updates)::BIGINT AS events_updates, sum(events_deletes)::BIGINT AS events_deletes FROM stats WHERE logged_ms >= {{as_of}} - 259200000 GROUP BY 1, 2")
def _(t):
    return r.events_by_connection(t.stats, AS_OF)


@query("ops_capture_lag", "SELECT conn_id, status AS capture_status, capture_lag_seconds, CAST(status <> 'healthy' AS INT) AS is_unhealthy FROM capture_position")
def _(t):
    return r.capture_overview(t.capture_position).drop("last_error_short").orderBy(F.desc_nulls_last("capture_lag_seconds"))


@query("ops_catalog_status", "SELECT status, count(*) AS count FROM catalog WHERE active GROUP BY status")
def _(t):
    return r.count_active(t.catalog, "status")


@query("ops_engine_mix", "SELECT db_engine, count(*) AS count FROM catalog WHERE active GROUP BY db_engine")
def _(t):
    return r.count_active(t.catalog, "db_engine")


@query("ops_errors_by_component", "SELECT component, count(*) AS error_count FROM logs WHERE level = 'error' AND logged_ms > {as_of} - 86400000 GROUP BY component ORDER BY error_count DESC, component LIMIT 12")
def _(t):
    return r.errors_by_component(t.logs, AS_OF)


@query("ops_recent_errors", "SELECT log_id, logged_ms, level, component, message FROM logs WHERE level IN ('error', 'warning') AND logged_ms > {as_of} - 86400000 ORDER BY logged_ms DESC, log_id DESC LIMIT 20")
def _(t):
    rows = t.logs.where(F.col("level").isin("error", "warning") & (F.col("logged_ms") > AS_OF - r.DAY))
    return r.newest(rows, "logged_ms", "log_id", 20).select("log_id", "logged_ms", "level", "component", "message")


@query("ops_apply_tail", "SELECT stat_id, logged_ms, conn_id, events_total, duration_ms FROM stats WHERE logged_ms >= {as_of} - 86400000 ORDER BY logged_ms DESC, stat_id DESC LIMIT 30")
def _(t):
    return r.newest(r.retain(t.stats, "logged_ms", AS_OF, 1), "logged_ms", "stat_id", 30).select("stat_id", "logged_ms", "conn_id", "events_total", "duration_ms")


@query(
    "ops_pipeline_tables",
    """SELECT c.catalog_id, c.conn_id, c.db_engine, c.status, coalesce(d.n, 0) AS events_24h, coalesce(m.n, 0) AS events_total_5m, coalesce(m.i, 0) AS events_inserts_5m, coalesce(m.u, 0) AS events_updates_5m, coalesce(m.x, 0) AS events_deletes_5m,
  coalesce(l.kafka_consumer_lag, 0) AS kafka_consumer_lag, cp.status AS capture_status, cp.capture_lag_seconds, ap.apply_lag_seconds, ap.kafka_partition
FROM catalog c LEFT JOIN capture_position cp ON cp.conn_id = c.conn_id LEFT JOIN apply_position ap ON ap.catalog_id = c.catalog_id
LEFT JOIN (SELECT catalog_id, sum(events_total)::BIGINT AS n FROM stats WHERE logged_ms >= {as_of} - 86400000 GROUP BY 1) d ON d.catalog_id = c.catalog_id
LEFT JOIN (SELECT catalog_id, sum(events_total)::BIGINT AS n, sum(events_inserts)::BIGINT AS i, sum(events_updates)::BIGINT AS u, sum(events_deletes)::BIGINT AS x FROM stats WHERE logged_ms >= {as_of} - 300000 GROUP BY 1) m ON m.catalog_id = c.catalog_id
LEFT JOIN (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY logged_ms DESC, stat_id DESC) = 1) l ON l.catalog_id = c.catalog_id
WHERE c.active""",
)
def _(t):
    return r.pipeline_tables(t.catalog, t.stats, t.apply_position, t.capture_position, AS_OF)


@query("ops_gap_events", "SELECT gap_id, detected_ms, conn_id, gap_side, detail FROM gap_events WHERE resolved_ms IS NULL ORDER BY detected_ms DESC, gap_id DESC LIMIT 25")
def _(t):
    return r.newest(t.gap_events.where("resolved_ms is null"), "detected_ms", "gap_id", 25).select("gap_id", "detected_ms", "conn_id", "gap_side", "detail")


@query("ops_apply_duration_hourly", f"SELECT {HOUR}, round(avg(duration_ms), 1) AS avg_duration_ms, max(duration_ms) AS max_duration_ms FROM stats WHERE logged_ms >= {{as_of}} - 259200000 GROUP BY 1")
def _(t):
    return r.duration_hourly(t.stats, AS_OF)


@query("ops_quarantine_by_conn", "SELECT conn_id, count(*) AS quarantined FROM catalog WHERE active AND status = 'quarantined' GROUP BY 1")
def _(t):
    return r.count_active(t.catalog.where("status = 'quarantined'"), "conn_id").withColumnRenamed("count", "quarantined")


@query("ops_event_loss_mix", f"SELECT event_loss_status AS status, count(*) AS count FROM ({LATEST}) GROUP BY 1")
def _(t):
    return r.event_loss_mix(t.stats, AS_OF)


@query("ops_top_lag_tables", f"SELECT catalog_id, conn_id, kafka_consumer_lag, apply_health_rag FROM ({LATEST}) WHERE kafka_consumer_lag > 0 ORDER BY kafka_consumer_lag DESC, catalog_id LIMIT 12")
def _(t):
    return r.top_lag(t.stats, AS_OF)


@query("ops_dlq_tail", "SELECT dlq_id, logged_ms, conn_id, reason, left(error_message, 240) AS error_message FROM dlq WHERE status = 'parked' ORDER BY logged_ms DESC, dlq_id DESC LIMIT 25")
def _(t):
    return r.newest(t.dlq.where("status = 'parked'"), "logged_ms", "dlq_id", 25).select("dlq_id", "logged_ms", "conn_id", "reason", F.left("error_message", F.lit(240)).alias("error_message"))


RICH = f"""SELECT c.*, c.status = 'quarantined' OR coalesce(p.status = 'quarantined', false) AS quarantined,
  CASE WHEN c.status = 'quarantined' OR coalesce(p.status = 'quarantined', false) OR c.status IN ('error', 'failed') THEN 'RED' WHEN l.apply_health_rag IS NOT NULL THEN l.apply_health_rag WHEN c.needs_full_load THEN 'AMBER' ELSE 'UNKNOWN' END AS health_rag
FROM catalog c LEFT JOIN apply_position p ON p.catalog_id = c.catalog_id LEFT JOIN ({LATEST}) l ON l.catalog_id = c.catalog_id WHERE c.active"""


@query("cat_list", f"SELECT catalog_id, conn_id, health_rag, quarantined, count(*) OVER () AS total FROM ({RICH}) WHERE source_schema ILIKE '%BUILD%' ORDER BY CASE health_rag WHEN 'RED' THEN 0 WHEN 'AMBER' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END, conn_id, source_schema, catalog_id LIMIT 50 OFFSET 10")
def _(t):
    return r.catalog_page(r.enriched_catalog(t.catalog, t.stats, t.apply_position, AS_OF), "BUILD", 10, 50)


@query("cat_overview_summary", f"SELECT count(*) AS tables_active, count(*) FILTER (cdc_enabled) AS tables_cdc, count(*) FILTER (health_rag = 'RED') AS rag_red, count(*) FILTER (health_rag = 'AMBER') AS rag_amber, count(*) FILTER (health_rag = 'GREEN') AS rag_green, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (needs_full_load) AS needs_full_load FROM ({RICH})")
def _(t):
    return r.overview_summary(r.enriched_catalog(t.catalog, t.stats, t.apply_position, AS_OF))


@query("cat_overview_queue", f"SELECT catalog_id, conn_id, health_rag, status FROM ({RICH}) WHERE health_rag IN ('RED', 'AMBER') OR quarantined OR needs_full_load OR status IN ('error', 'full_load_in_progress', 'pending', 'needs_full_load') ORDER BY CASE health_rag WHEN 'RED' THEN 0 WHEN 'AMBER' THEN 1 ELSE 2 END, conn_id, source_schema, catalog_id LIMIT 50")
def _(t):
    return r.overview_queue(r.enriched_catalog(t.catalog, t.stats, t.apply_position, AS_OF))


@query("cat_detail", "SELECT catalog_id, stat_id, logged_ms, row_number() OVER (PARTITION BY catalog_id ORDER BY logged_ms DESC, stat_id DESC)::INT AS nth FROM stats QUALIFY nth <= 5")
def _(t):
    return r.last_per_table(t.stats, "logged_ms", "stat_id").select("catalog_id", "stat_id", "logged_ms", "nth")


@query("conn_summary", "SELECT conn_id, count(*) AS tables_total, count(*) FILTER (active) AS tables_active, count(*) FILTER (active AND cdc_enabled AND NOT needs_full_load) AS cdc_ready, count(*) FILTER (needs_full_load) AS needs_full_load, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status IN ('error', 'failed')) AS failed FROM catalog GROUP BY 1")
def _(t):
    return r.connection_summary(t.catalog)


@query("conn_hourly", f"SELECT conn_id, {HOUR}, sum(events_total)::BIGINT AS events, max(kafka_consumer_lag) AS kafka_lag, round(avg(apply_lag_seconds))::INT AS apply_lag FROM stats WHERE logged_ms >= {{as_of}} - 86400000 GROUP BY 1, 2")
def _(t):
    return r.connection_hourly(t.stats, AS_OF)


@query("conn_recent", "SELECT alias, coalesce(sum(events_total), 0)::BIGINT AS events_5m FROM connections LEFT JOIN (SELECT * FROM stats WHERE logged_ms >= {as_of} - 300000) s ON s.conn_id = alias GROUP BY 1")
def _(t):
    return r.connection_recent(t.connections, t.stats, AS_OF)


@query("conn_capture", "SELECT conn_id, status, capture_lag_seconds FROM capture_position")
def _(t):
    return t.capture_position.select("conn_id", "status", "capture_lag_seconds")


@query("pipeline_ok", f"SELECT *, pending_load = 0 AND quarantined = 0 AND red = 0 AS ok FROM (SELECT (SELECT count(*) FROM catalog WHERE active AND needs_full_load) AS pending_load, (SELECT count(*) FROM catalog WHERE active AND status = 'quarantined') AS quarantined, (SELECT count(*) FROM ({LATEST}) WHERE apply_health_rag = 'RED') AS red)")
def _(t):
    return r.pipeline_ok(t.catalog, t.stats, AS_OF)


@query("logs_page", "SELECT log_id, logged_ms, component, count(*) OVER () AS total FROM logs WHERE level = 'warning' AND conn_id = 'conn_3' ORDER BY logged_ms DESC, log_id DESC LIMIT 20 OFFSET 20")
def _(t):
    rows = t.logs.where("level = 'warning' and conn_id = 'conn_3'")
    return r.page_with_total(rows, "logged_ms", "log_id", 20, 20).select("log_id", "logged_ms", "component", "total")


@query("lineage_page", "SELECT lineage_id, created_ms, event_type FROM lineage WHERE conn_id = 'conn_5' ORDER BY created_ms DESC, lineage_id DESC LIMIT 50")
def _(t):
    return r.newest(t.lineage.where("conn_id = 'conn_5'"), "created_ms", "lineage_id", 50).select("lineage_id", "created_ms", "event_type")


@query("notif_page", "SELECT notification_id, created_ms, severity, count(*) OVER () AS total FROM notifications WHERE acked_ms IS NULL ORDER BY created_ms DESC, notification_id DESC LIMIT 40")
def _(t):
    return r.page_with_total(t.notifications.where("acked_ms is null"), "created_ms", "notification_id", 0, 40).select("notification_id", "created_ms", "severity", "total")


@query("capture_branches", "SELECT conn_id, count(*) FILTER (NOT needs_full_load) AS main_tables, count(*) FILTER (needs_full_load AND capture_during_full_load) AS stream_tables FROM catalog WHERE active AND cdc_enabled AND has_pk GROUP BY 1")
def _(t):
    return r.capture_branches(t.catalog)


@query("dlq_parked_count", "SELECT catalog_id, count(*) AS parked FROM dlq WHERE status = 'parked' GROUP BY 1")
def _(t):
    return t.dlq.where("status = 'parked'").groupBy("catalog_id").agg(F.count("*").alias("parked"))


@query("retain_stats_age", "SELECT stat_id, logged_ms FROM stats WHERE logged_ms >= {as_of} - 259200000")
def _(t):
    return r.retain(t.stats, "logged_ms", AS_OF, 3).select("stat_id", "logged_ms")


@query("retain_stats_idle", "SELECT stat_id FROM stats WHERE NOT (is_inactive OR (events_total = 0 AND events_seen_in_slice = 0))")
def _(t):
    return r.retain_active(t.stats).select("stat_id")


@query("retain_dlq", "SELECT dlq_id, status FROM dlq WHERE status = 'parked' OR coalesce(resolved_ms, logged_ms) >= {as_of} - 1296000000")
def _(t):
    return r.retain_dlq(t.dlq, AS_OF, 15).select("dlq_id", "status")


@query("retain_logs", "SELECT log_id FROM logs WHERE logged_ms >= {as_of} - 259200000")
def _(t):
    return r.retain(t.logs, "logged_ms", AS_OF, 3).select("log_id")
