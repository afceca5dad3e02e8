"""Tables derived from the given ones: a change log, a catalog with its positions, and the pipeline's bookkeeping."""

from .registry import derive

derive("ev", "SELECT event_id AS e, user_id AS u, event_type AS t, MS(ts) AS ms, CAST(round(value * 100) AS BIGINT) AS cents, props FROM events")
derive(
    "changes",
    """
SELECT 'lake.b' || CAST(u % 8 AS STRING) AS topic, CAST(u % 24 AS INT) AS part, e AS pos, 'ev:' || CAST(e AS STRING) AS event_id,
  CASE t WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
  u % 5 AS catalog_id, u AS user_id, t AS event_type, cents, ms AS ts_ms
FROM ev""",
)
derive(
    "connections",
    """
SELECT 'conn_' || CAST(n_nationkey AS STRING) AS alias, CASE n_nationkey % 3 WHEN 0 THEN 'mariadb' WHEN 1 THEN 'mssql' ELSE 'mongodb' END AS db_engine,
  n_nationkey % 7 <> 3 AS active FROM nation""",
)
derive(
    "catalog",
    """
SELECT c_custkey AS catalog_id, 'conn_' || CAST(c_nationkey AS STRING) AS conn_id,
  CASE c_nationkey % 3 WHEN 0 THEN 'mariadb' WHEN 1 THEN 'mssql' ELSE 'mongodb' END AS db_engine,
  'db' || CAST(c_custkey % 4 AS STRING) AS source_database, lower(c_mktsegment) AS source_schema, 't_' || CAST(c_custkey AS STRING) AS source_table,
  c_custkey % 19 <> 0 AS has_pk, CASE WHEN c_custkey % 3 = 0 THEN 'id' ELSE 'tenant, id' END AS pk_columns,
  c_custkey % 10 <> 7 AS active, c_custkey % 6 <> 1 AS cdc_enabled, c_custkey % 8 = 2 AS needs_full_load,
  CASE c_custkey % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'full_load_in_progress' WHEN 2 THEN 'cdc_in_progress' WHEN 3 THEN 'skipped' WHEN 4 THEN 'quarantined' WHEN 5 THEN 'error' WHEN 6 THEN 'disabled' ELSE 'success' END AS status,
  c_custkey % 4 = 1 AS capture_during_full_load, c_custkey % 2 = 0 AS scd2_enabled,
  CASE c_custkey % 5 WHEN 0 THEN 'initial' WHEN 1 THEN 'never' WHEN 2 THEN 'schema_only' WHEN 3 THEN 'incremental' ELSE 'when_needed' END AS snapshot_mode,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE {as_of} - c_custkey * 60000 END AS updated_ms, {as_of} - 7776000000 AS discovered_ms,
  CASE WHEN c_custkey % 11 = 5 THEN 'failed: ' || c_name ELSE NULL END AS last_error,
  {as_of} - (c_custkey % 400) * 60000 AS last_error_ms, c_custkey % 7 AS load_failures
FROM customer""",
)
derive(
    "apply_position",
    """
SELECT c_custkey AS catalog_id, 'conn_' || CAST(c_nationkey AS STRING) AS conn_id,
  CASE c_custkey % 9 WHEN 0 THEN 'stale' WHEN 1 THEN 'lagging' WHEN 2 THEN 'quarantined' WHEN 3 THEN 'failed' WHEN 4 THEN 'gap_detected' ELSE 'healthy' END AS status,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {as_of} - (c_custkey % 1300) * 1000 END AS last_applied_ms, CAST(c_custkey % 1300 AS INT) AS apply_lag_seconds,
  'lake.b' || CAST(c_custkey % 8 AS STRING) AS kafka_topic, CAST(c_custkey % 24 AS INT) AS kafka_partition, c_custkey * 10 AS kafka_offset,
  CASE WHEN c_custkey % 9 = 2 THEN 'dlq overflow' ELSE NULL END AS quarantine_reason, CASE WHEN c_custkey % 9 = 3 THEN 'error of ' || c_name ELSE NULL END AS last_error,
  c_custkey % 17 = 0 AS replay_requested
FROM customer WHERE c_custkey % 5 <> 0""",
)
derive(
    "capture_position",
    """
SELECT 'conn_' || CAST(n_nationkey AS STRING) AS conn_id, CASE n_nationkey % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'stale' WHEN 2 THEN 'failed' WHEN 3 THEN 'lagging' ELSE 'healthy' END AS status,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE {as_of} - n_nationkey * 20000 END AS last_event_ms, CASE WHEN n_nationkey = 24 THEN NULL ELSE {as_of} - n_nationkey * 25000 END AS updated_ms,
  CAST(n_nationkey * 31 AS INT) AS capture_lag_seconds, CASE WHEN n_nationkey % 5 = 2 THEN 'lost ' || n_name ELSE NULL END AS last_error
FROM nation""",
)
derive(
    "stats",
    """
SELECT e AS stat_id, 'batch_' || CAST(e % 100 AS STRING) AS batch_id, 'conn_' || CAST(u % 25 AS STRING) AS conn_id, u AS catalog_id, 's' || CAST(u % 3 AS STRING) AS source_schema, 't_' || CAST(u AS STRING) AS source_table,
  e % 7 AS events_inserts, e % 5 AS events_updates, e % 3 AS events_deletes, e % 7 + e % 5 + e % 3 AS events_total, cents % 5000 AS duration_ms,
  ms AS logged_ms, t = 'error' AS is_stale, t = 'view' AS is_inactive, e % 41 = 0 AS is_quarantined,
  CASE e % 4 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'AMBER' WHEN 2 THEN 'RED' ELSE 'UNKNOWN' END AS apply_health_rag, CAST(e % 1000 AS INT) AS apply_lag_seconds,
  CASE WHEN e % 6 = 0 THEN NULL ELSE CAST(e % 700 AS INT) END AS capture_lag_seconds, (e * 37) % 60000 AS kafka_consumer_lag, e % 900 - 1 AS kafka_partition_lag,
  CAST(e % 50 AS INT) AS events_seen_in_slice, CAST(e % 11 AS INT) AS dedup_skipped, CASE WHEN e % 29 = 0 THEN e % 4 ELSE 0 END AS parse_skipped, CASE WHEN e % 83 = 0 THEN 1 ELSE 0 END AS dropped_unrecoverable,
  CASE WHEN e % 83 = 0 THEN 'fail' WHEN e % 29 = 0 THEN 'warn' ELSE 'ok' END AS event_loss_status,
  CASE e % 6 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'stale' WHEN 2 THEN 'ok' WHEN 3 THEN 'failed' WHEN 4 THEN '' ELSE 'healthy' END AS apply_status
FROM ev""",
)
derive(
    "logs",
    """
SELECT e AS log_id, ms AS logged_ms, CASE t WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS level, 'comp_' || CAST(u % 17 AS STRING) AS component,
  'conn_' || CAST(u % 25 AS STRING) AS conn_id, u AS catalog_id, t || ' ' || CAST(e AS STRING) AS message FROM ev""",
)
derive(
    "dlq",
    """
SELECT e AS dlq_id, u AS catalog_id, 'conn_' || CAST(u % 25 AS STRING) AS conn_id, 's' || CAST(u % 3 AS STRING) AS source_schema, 't_' || CAST(u AS STRING) AS source_table,
  CASE e % 2 WHEN 0 THEN 'apply_error' ELSE 'unresolved_table' END AS reason, CASE e % 3 WHEN 0 THEN 'parked' WHEN 1 THEN 'retried' ELSE 'discarded' END AS status,
  CASE e % 9 WHEN 0 THEN '22003' WHEN 1 THEN '23514' WHEN 2 THEN '40P01' WHEN 3 THEN '08006' WHEN 4 THEN '57014' WHEN 5 THEN '42P01' ELSE '' END AS error_sqlstate,
  CASE e % 5 WHEN 0 THEN 'new row violates check' WHEN 1 THEN 'server closed the connection' WHEN 2 THEN 'value too long for type' WHEN 3 THEN 'Connection reset; out of range' ELSE 'odd' END AS error_message,
  ms AS logged_ms, CASE WHEN e % 3 = 0 THEN NULL ELSE ms + 86400000 END AS resolved_ms
FROM ev WHERE t = 'error'""",
)
derive(
    "gap_events",
    """
SELECT e AS gap_id, ms AS detected_ms, 'conn_' || CAST(u % 25 AS STRING) AS conn_id, u AS catalog_id, CASE e % 2 WHEN 0 THEN 'capture' ELSE 'apply' END AS gap_side,
  CASE e % 5 WHEN 0 THEN 'server_uuid changed' WHEN 1 THEN 'cdc lsn purged' WHEN 2 THEN 'kafka offset out of range' WHEN 3 THEN 'mssql cdc retention' ELSE 'log gone' END AS detail,
  CASE WHEN e % 4 = 0 THEN ms + 60000 ELSE NULL END AS resolved_ms
FROM ev WHERE e % 23 = 0""",
)
derive(
    "checkpoints",
    """
SELECT c_custkey AS catalog_id, CAST(c_custkey % 4 AS INT) AS worker_id, CASE c_custkey % 3 WHEN 0 THEN 'truncate' WHEN 1 THEN 'copy' ELSE 'ddl' END AS phase,
  c_custkey * 100 AS rows_loaded, c_custkey * 100 + c_custkey % 5 AS source_rows, {as_of} - (c_custkey % 90) * 60000 AS updated_ms
FROM customer WHERE c_custkey % 3 <> 2
UNION ALL
SELECT c_custkey, 9, 'copy', 7, c_custkey * 90, {as_of} - 1000 FROM customer WHERE c_custkey % 6 = 0""",
)
derive(
    "signals",
    """
SELECT c_custkey AS catalog_id, CASE c_custkey % 2 WHEN 0 THEN 'execute_blocking' ELSE 'execute_incremental' END AS action,
  CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' ELSE 'done' END AS status FROM customer WHERE c_custkey % 7 = 0""",
)
derive("lineage", "SELECT e AS lineage_id, ms AS created_ms, 'conn_' || CAST(u % 25 AS STRING) AS conn_id, u AS catalog_id, CASE e % 3 WHEN 0 THEN 'START' WHEN 1 THEN 'COMPLETE' ELSE 'FAIL' END AS event_type FROM ev WHERE e % 5 = 0")
derive("notifications", "SELECT e AS notification_id, ms AS created_ms, 'conn_' || CAST(u % 25 AS STRING) AS conn_id, t AS severity, CASE WHEN e % 3 = 0 THEN ms + 1 ELSE NULL END AS acked_ms FROM ev WHERE e % 4 = 0")
derive("before_rows", "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 13 <> 5")
derive("after_rows", "SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 11 <> 0")
