"""Health, loads, drift and catalog upkeep."""

from pyspark.sql import functions as F

from ..operators import drift as d
from ..operators import health as h
from ..operators import load as ld
from ..sources.scratch import scratch_path
from .registry import AS_OF, derive, query

STICKY = "status IN ('quarantined', 'failed', 'gap_detected')"
LIVE = "catalog_id IN (SELECT catalog_id FROM catalog WHERE active AND cdc_enabled AND NOT needs_full_load)"


@query("health_apply_position", f"SELECT catalog_id, CASE WHEN {STICKY} OR lag IS NULL THEN status WHEN lag > 900 THEN 'stale' WHEN lag > 450 THEN 'lagging' WHEN status IN ('stale', 'lagging') THEN 'healthy' ELSE status END AS status, coalesce(lag, 0) AS apply_lag_seconds FROM (SELECT *, ({{as_of}} - last_applied_ms) // 1000 AS lag FROM apply_position) WHERE {LIVE}")
def _(t):
    return h.apply_position_health(t.apply_position, t.catalog, AS_OF).select("catalog_id", "status", "apply_lag_seconds")


@query("health_capture_position", f"SELECT conn_id, CASE WHEN {STICKY} THEN status WHEN idle > 300 THEN 'stale' WHEN status = 'stale' THEN 'healthy' ELSE status END AS status, CASE WHEN {STICKY} OR idle > 300 OR status = 'stale' THEN capture_lag_seconds ELSE ({{as_of}} - coalesce(last_event_ms, updated_ms)) // 1000 END AS capture_lag_seconds FROM (SELECT *, ({{as_of}} - updated_ms) // 1000 AS idle FROM capture_position) WHERE updated_ms IS NOT NULL")
def _(t):
    return h.capture_position_health(t.capture_position, AS_OF).select("conn_id", "status", "capture_lag_seconds")


@query("health_snapshot", "SELECT c.catalog_id, c.active, c.cdc_enabled, p.status AS apply_status, coalesce(({as_of} - p.last_applied_ms) // 1000, -1) AS seconds_since_last_apply, CASE WHEN c.db_engine = 'mariadb' THEN coalesce(x.capture_lag_seconds, 0) ELSE 0 END AS capture_lag_seconds, coalesce(p.status = 'quarantined', false) AS is_quarantined FROM catalog c LEFT JOIN apply_position p ON p.catalog_id = c.catalog_id LEFT JOIN capture_position x ON x.conn_id = c.conn_id")
def _(t):
    return h.snapshot(t.catalog, t.apply_position, t.capture_position, AS_OF)


SEVERITY = "CASE WHEN is_inactive OR kafka_consumer_lag <= 0 THEN 'none' WHEN kafka_consumer_lag >= 50000 THEN 'critical' WHEN kafka_consumer_lag >= 1000 THEN 'warn' ELSE 'none' END"
RICH = f"SELECT *, {SEVERITY} AS sev FROM stats"


def judged(t):
    s = t.stats.withColumn("severity", h.lag_severity(F.col("kafka_consumer_lag"), F.col("is_inactive")))
    return s.withColumn("loss", h.event_loss(F.col("parse_skipped"), F.col("dropped_unrecoverable")))


@query("health_lag_severity", f"SELECT stat_id, {SEVERITY} AS severity FROM stats")
def _(t):
    return judged(t).select("stat_id", "severity")


@query("health_event_loss", "SELECT stat_id, CASE WHEN dropped_unrecoverable > 0 THEN 'fail' WHEN parse_skipped > 0 THEN 'warn' ELSE 'ok' END AS loss FROM stats")
def _(t):
    return judged(t).select("stat_id", "loss")


LOSS = "CASE WHEN dropped_unrecoverable > 0 THEN 'fail' WHEN parse_skipped > 0 THEN 'warn' ELSE 'ok' END"


@query("health_rag", f"SELECT stat_id, CASE WHEN is_quarantined OR apply_status IN ('quarantined', 'failed') THEN 'RED' WHEN {LOSS} = 'fail' OR sev = 'critical' THEN 'RED' WHEN is_stale OR apply_status = 'stale' OR {LOSS} = 'warn' OR sev = 'warn' THEN 'AMBER' ELSE 'GREEN' END AS rag FROM ({RICH})")
def _(t):
    return judged(t).select("stat_id", h.rag(F.col("is_stale"), F.col("is_quarantined"), F.col("apply_status"), F.col("loss"), F.col("severity")).alias("rag"))


@query("health_reason", f"SELECT stat_id, CASE WHEN is_quarantined OR apply_status = 'quarantined' THEN 'apply_quarantined' WHEN apply_status = 'failed' THEN 'apply_failed' WHEN {LOSS} = 'fail' THEN 'event_loss_unrecoverable' WHEN {LOSS} = 'warn' THEN 'parse_skipped' WHEN is_stale OR apply_status = 'stale' THEN 'apply_stale' WHEN sev = 'critical' THEN 'kafka_backlog_critical' WHEN sev = 'warn' THEN 'kafka_backlog' WHEN capture_lag_seconds > 300 THEN 'capture_lag_high' WHEN is_inactive THEN 'slice_quiet' ELSE 'healthy' END AS reason FROM ({RICH})")
def _(t):
    return judged(t).select("stat_id", h.reason(F.col("is_stale"), F.col("is_quarantined"), F.col("apply_status"), F.col("loss"), F.col("severity"), F.col("capture_lag_seconds"), F.col("is_inactive")).alias("reason"))


@query("lag_partition", "SELECT topic, part, CASE WHEN part = 0 THEN 0 WHEN part % 5 = 1 THEN -1 ELSE greatest(hi + part - 10 - hi - 1, 0) END AS lag FROM (SELECT topic, part, max(pos) AS hi FROM changes GROUP BY 1, 2)")
def _(t):
    ends = t.changes.groupBy("topic", "part").agg(F.max("pos").alias("hi")).select("topic", "part", F.when(F.col("part") == 0, 0).otherwise(F.col("hi") + F.col("part") - 10).alias("end"))
    return h.partition_lag(t.changes.where("part % 5 <> 1"), ends).select("topic", "part", "lag")


@query("lag_heartbeat", "SELECT conn_id, max(logged_ms) AS last_ms, CASE WHEN ({as_of} - max(logged_ms)) // 1000 > 7200 THEN 'stale' WHEN ({as_of} - max(logged_ms)) // 1000 > 3600 THEN 'late' ELSE 'ok' END AS state FROM logs GROUP BY 1")
def _(t):
    last = t.logs.groupBy("conn_id").agg(F.max("logged_ms").alias("last_ms"))
    age = h.age_s(F.col("last_ms"), AS_OF)
    return last.withColumn("state", F.when(age > 7200, "stale").when(age > 3600, "late").otherwise("ok"))


@query("gap_kind", "SELECT gap_id, CASE gap_id % 5 WHEN 0 THEN 'server_uuid_changed' WHEN 1 THEN 'mssql_lsn_purged' WHEN 2 THEN 'kafka_offset_lost' WHEN 3 THEN 'mssql_lsn_purged' ELSE 'binlog_purged' END AS kind FROM gap_events")
def _(t):
    return t.gap_events.select("gap_id", h.gap_kind(F.col("detail")).alias("kind"))


derive("log_starts", "SELECT topic, part, min(pos) + 5000 AS start FROM (SELECT kafka_topic AS topic, kafka_partition AS part, kafka_offset AS pos FROM apply_position) x GROUP BY topic, part")


@query("gap_offset_lost", "SELECT catalog_id, conn_id, 'kafka_offset_lost' AS gap_kind, start - kafka_offset AS lost FROM apply_position JOIN log_starts ON topic = kafka_topic AND part = kafka_partition WHERE kafka_offset < start")
def _(t):
    return h.offsets_lost(t.apply_position, t.log_starts)


@query("gap_sweep", "SELECT p.catalog_id, 'apply' AS side, c.conn_id FROM apply_position p JOIN catalog c ON c.catalog_id = p.catalog_id WHERE p.status = 'gap_detected' AND c.active UNION ALL SELECT catalog_id, 'capture', conn_id FROM catalog WHERE active AND conn_id = 'conn_4'")
def _(t):
    capture = t.capture_position.withColumn("status", F.when(F.col("conn_id") == "conn_4", "gap_detected").otherwise(F.col("status")))
    return h.gap_sweep(t.catalog, t.apply_position, capture)


@query("gap_resolve", "SELECT gap_id FROM gap_events g WHERE resolved_ms IS NULL AND CASE gap_side WHEN 'apply' THEN catalog_id IN (SELECT catalog_id FROM apply_position WHERE status = 'healthy') ELSE conn_id IN (SELECT conn_id FROM capture_position WHERE status = 'healthy') END")
def _(t):
    return h.gap_resolve(t.gap_events, t.apply_position, t.capture_position)


@query("state_clear_stale", "SELECT catalog_id, CASE WHEN status = 'cdc_in_progress' AND coalesce(updated_ms, 0) < {as_of} - 300000 THEN CASE WHEN needs_full_load THEN 'pending' ELSE 'success' END ELSE status END AS status FROM catalog")
def _(t):
    return h.clear_stale(t.catalog, AS_OF).select("catalog_id", "status")


OUTCOME = "SELECT c_custkey AS catalog_id, CASE c_custkey % 7 WHEN 0 THEN 'cdc_start' WHEN 1 THEN 'cdc_success' WHEN 2 THEN 'cdc_failure' WHEN 3 THEN 'load_start' WHEN 4 THEN 'load_ready' ELSE 'skipped' END AS outcome, 'm' || CAST(c_custkey AS STRING) AS message FROM customer WHERE c_custkey % 7 <> 6"
derive("outcomes", OUTCOME)


@query("state_catalog_transition", "SELECT c.catalog_id, CASE outcome WHEN 'cdc_start' THEN 'cdc_in_progress' WHEN 'cdc_success' THEN 'success' WHEN 'cdc_failure' THEN 'error' WHEN 'load_start' THEN 'full_load_in_progress' WHEN 'load_ready' THEN 'pending' WHEN 'skipped' THEN 'skipped' ELSE status END AS status, CASE WHEN outcome IN ('cdc_failure', 'skipped') THEN message WHEN outcome IN ('cdc_success', 'load_ready') THEN NULL ELSE last_error END AS last_error, needs_full_load AND coalesce(outcome <> 'load_ready', true) AS needs_full_load FROM catalog c LEFT JOIN outcomes o ON o.catalog_id = c.catalog_id")
def _(t):
    return h.transition(t.catalog, t.outcomes).select("catalog_id", "status", "last_error", "needs_full_load")


@query("state_load_retry", "SELECT catalog_id, CASE WHEN n >= 5 AND cool THEN 0 ELSE n END AS load_failures, n < 5 OR cool AS needs_full_load, CASE WHEN n >= 5 AND NOT cool THEN last_error || ' (stopped)' ELSE last_error END AS last_error FROM (SELECT *, load_failures + 1 AS n, last_error_ms <= {as_of} - 14400000 AS cool FROM catalog WHERE status = 'error')")
def _(t):
    return h.load_retry(t.catalog, AS_OF)


OVER = "SELECT k.catalog_id, k.worker_id FROM checkpoints k JOIN catalog c ON c.catalog_id = k.catalog_id WHERE phase = 'copy' AND (NOT needs_full_load OR status IN ('skipped', 'disabled', 'quarantined') OR k.updated_ms < {as_of} - 3600000)"


@query("state_stale_checkpoints", f"SELECT catalog_id, worker_id, phase FROM checkpoints WHERE (catalog_id, worker_id) NOT IN ({OVER})")
def _(t):
    return h.stale_checkpoints(t.checkpoints, t.catalog, AS_OF)[0].select("catalog_id", "worker_id", "phase")


@query("state_stale_checkpoints_reset", f"SELECT catalog_id FROM catalog WHERE status = 'full_load_in_progress' AND catalog_id IN (SELECT catalog_id FROM ({OVER}))")
def _(t):
    return h.stale_checkpoints(t.checkpoints, t.catalog, AS_OF)[1]


@query("state_load_resume", "SELECT catalog_id, 'pending' AS status FROM catalog WHERE status = 'full_load_in_progress' AND (catalog_id IN (SELECT catalog_id FROM checkpoints WHERE phase = 'copy') OR coalesce(updated_ms, 0) < {as_of} - 7200000)")
def _(t):
    return h.resume_loads(t.catalog, t.checkpoints, AS_OF)


@query("state_set_mode", "SELECT catalog_id, CASE catalog_id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE active END AS active, CASE catalog_id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE cdc_enabled END AS cdc_enabled, CASE catalog_id % 6 WHEN 2 THEN true WHEN 3 THEN false ELSE scd2_enabled END AS scd2_enabled, catalog_id % 6 = 4 OR needs_full_load AS needs_full_load FROM catalog")
def _(t):
    req = t.catalog.select("catalog_id", F.element_at(F.array(*[F.lit(x) for x in ("enable", "disable", "scd2_on", "scd2_off", "reload", None)]), (F.col("catalog_id") % 6 + 1).cast("int")).alias("request"))
    return h.set_mode(t.catalog, req).select("catalog_id", "active", "cdc_enabled", "scd2_enabled", "needs_full_load")


derive("named_position", "SELECT p.catalog_id, p.conn_id, c.source_schema, c.source_table, p.status FROM apply_position p JOIN catalog c ON p.catalog_id = c.catalog_id")
#: Tables made anew under their old name have another id.
derive("eligible", "SELECT CASE WHEN catalog_id % 10 = 3 THEN catalog_id + 1000000 ELSE catalog_id END AS catalog_id, conn_id, source_schema, source_table FROM catalog WHERE active AND has_pk UNION ALL SELECT catalog_id + 2000000, conn_id, source_schema, source_table FROM catalog WHERE active AND has_pk AND catalog_id % 20 = 3")


@query("position_seed", "SELECT p.* FROM named_position p WHERE NOT EXISTS (SELECT 1 FROM eligible e WHERE e.conn_id = p.conn_id AND e.source_schema = p.source_schema AND e.source_table = p.source_table AND e.catalog_id NOT IN (SELECT catalog_id FROM named_position)) UNION ALL SELECT max(catalog_id), conn_id, source_schema, source_table, 'healthy' FROM eligible WHERE catalog_id NOT IN (SELECT catalog_id FROM named_position) GROUP BY 2, 3, 4")
def _(t):
    return h.seed_positions(t.eligible, t.named_position)


@query("pending_counts", "SELECT conn_id, count(*) FILTER (needs_full_load) AS waiting_load, count(*) FILTER (NOT needs_full_load AND NOT cdc_enabled) AS waiting_onboard FROM catalog WHERE active GROUP BY 1")
def _(t):
    return h.pending_counts(t.catalog)


@query("state_unquarantine", "SELECT catalog_id, CASE WHEN catalog_id % 2 = 0 AND status = 'quarantined' THEN 'healthy' ELSE status END AS status, CASE WHEN catalog_id % 2 = 0 AND status = 'quarantined' THEN NULL ELSE quarantine_reason END AS quarantine_reason, replay_requested OR (catalog_id % 2 = 0 AND status = 'quarantined') AS replay_requested FROM apply_position")
def _(t):
    return h.unquarantine(t.apply_position, t.catalog.where("catalog_id % 2 = 0")).select("catalog_id", "status", "quarantine_reason", "replay_requested")


# ---------------------------------------------------------------- loads


@query("load_slices_int", "SELECT i AS slice, lo + i * w AS begin, CASE WHEN i = 7 THEN hi + 1 ELSE lo + (i + 1) * w END AS \"end\" FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, greatest(ceil((max(o_orderkey) - min(o_orderkey) + 1) / 8.0)::BIGINT, 1) AS w FROM orders), range(8) r(i)")
def _(t):
    return ld.int_slices(t.orders, "o_orderkey", 8)


@query("load_slices_sampled", "SELECT conv_id, turn, rank AS at FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rank, count(*) OVER () AS n FROM conversations) WHERE rank IN (n * 1 // 4, n * 2 // 4, n * 3 // 4)")
def _(t):
    return ld.sampled_boundaries(t.conversations, ["conv_id", "turn"], 4)


CUTS = "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 2500 = 7"


def order_slices(t):
    return ld.slice_bounds(t.orders.where("o_orderkey % 2500 = 7").select(F.col("o_orderkey").alias("k")), ["k"])


PLAN = f"SELECT 0 AS slice, NULL AS lo, min(k) AS hi FROM ({CUTS}) UNION ALL SELECT row_number() OVER (ORDER BY k), k, lead(k) OVER (ORDER BY k) FROM ({CUTS})"


@query("load_slice_bounds", PLAN)
def _(t):
    return order_slices(t).select("slice", F.col("begin.k").alias("lo"), F.col("end.k").alias("hi"))


@query("load_slice_assign", f"SELECT slice, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders JOIN ({PLAN}) ON (lo IS NULL OR o_orderkey >= lo) AND (hi IS NULL OR o_orderkey < hi) GROUP BY 1")
def _(t):
    rows = ld.assign(t.orders.withColumn("k", F.col("o_orderkey")), order_slices(t), ["k"])
    return rows.groupBy("slice").agg(F.count("*").alias("rows"), F.min("k").alias("first"), F.max("k").alias("last"))


@query("load_slice_contiguity", f"SELECT true AS contiguous, count(*) AS slices FROM ({PLAN})")
def _(t):
    return ld.contiguous(order_slices(t))


@query("load_tuple_predicate", "SELECT conv_id, turn, (conv_id, turn) > (20, 1) AS gt, (conv_id, turn) <= (50, 2) AS le, conv_id >= 30 AS prefix FROM conversations")
def _(t):
    cols = [F.col("conv_id"), F.col("turn")]
    return t.conversations.select("conv_id", "turn", ld.tuple_compare(cols, [20, 1], "gt").alias("gt"), ld.tuple_compare(cols, [50, 2], "le").alias("le"), ld.tuple_compare(cols, [30], "ge").alias("prefix"))


@query("load_resume", "SELECT o_orderkey, i AS slice FROM orders, (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, ceil((max(o_orderkey) - min(o_orderkey) + 1) / 4.0)::BIGINT AS w FROM orders), range(4) r(i) WHERE o_orderkey >= lo + i * w AND o_orderkey < lo + (i + 1) * w AND o_orderkey > CASE i WHEN 0 THEN 500 WHEN 1 THEN 4500 WHEN 2 THEN 9000 ELSE -1 END")
def _(t):
    s = ld.int_slices(t.orders, "o_orderkey", 4)
    a = s.where("slice < 2").select("slice", F.when(F.col("slice") == 0, 100).otherwise(4500).alias("last_key"))
    b = s.where("slice in (0, 2)").select("slice", F.when(F.col("slice") == 0, 500).otherwise(9000).alias("last_key"))
    return ld.resume(t.orders.select("o_orderkey"), s, "o_orderkey", a, b)


@query("load_copy_resume", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    """A copy that stops behind some slices and is gone on with."""
    path, rows = scratch_path(t.spark, "copy"), t.orders.select("o_orderkey", "o_custkey")

    def stop(_):
        raise InterruptedError

    try:
        ld.copy_slices(rows, order_slices(t), ["o_orderkey"], path, at_once=3, after=stop)
    except InterruptedError:
        pass
    return ld.copy_slices(rows, order_slices(t), ["o_orderkey"], path, at_once=3)


@query("load_copy", "SELECT count(*) FILTER (o_orderkey % 17 = 0) AS skipped, count(*) FILTER (o_orderkey % 17 <> 0) AS copied FROM orders")
def _(t):
    return ld.copy_rows(t.orders.withColumn("k", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey"))), "k")[1]


@query("load_incremental_merge", "SELECT * FROM after_rows UNION ALL SELECT * FROM before_rows WHERE k NOT IN (SELECT k FROM after_rows)")
def _(t):
    return ld.merge_incremental(t.before_rows, t.after_rows, ["k"])


#: Loads of all kinds: with and without a baseline, taking in changes or not, short, doubled, resumed, at sizes where the
#: tolerance counts, and with counts that nobody knows.
derive("loads", """SELECT catalog_id * 10 + worker_id AS catalog_id, CASE WHEN catalog_id % 9 = 0 THEN -1 ELSE want END AS source_rows,
  CASE catalog_id % 7 WHEN 0 THEN want * 2 + 900 WHEN 1 THEN want - 1 WHEN 2 THEN want + CAST(floor(want / 50000) AS BIGINT) WHEN 3 THEN want + CAST(floor(want / 5000) AS BIGINT) WHEN 4 THEN -1 WHEN 5 THEN want - CAST(floor(want / 3) AS BIGINT) ELSE want END AS lake_rows,
  CASE WHEN catalog_id % 2 = 0 THEN CASE WHEN catalog_id % 26 = 0 THEN -1 ELSE want - catalog_id % 3 END END AS baseline_rows,
  CASE catalog_id % 5 WHEN 0 THEN 0 WHEN 1 THEN want - CAST(floor(want / 4) AS BIGINT) ELSE want END AS rows_loaded, catalog_id % 4 = 0 AS reconciles
FROM (SELECT catalog_id, worker_id, CASE WHEN catalog_id % 3 = 0 THEN source_rows * 1000000 ELSE source_rows END AS want FROM checkpoints) w""")
_VERIFIED = """SELECT catalog_id, CASE kind WHEN 's' THEN CASE WHEN m = 'ok' AND rows_loaded > 0 AND lake_rows > rows_loaded THEN 'baseline_snapshot_streaming_resumed' ELSE 'baseline_snapshot_streaming' END
    WHEN 'b' THEN CASE WHEN m = 'ok' AND rows_loaded > 0 AND lake_rows > rows_loaded THEN 'baseline_snapshot_resumed' ELSE 'baseline_snapshot' END ELSE 'live_source' END AS mode,
  m IN ('ok', 'unknown') AS ok, CASE m WHEN 'unknown' THEN 'ok' ELSE m END AS message,
  CASE WHEN m = 'unknown' THEN 0 WHEN m = 'duplicate_load' THEN lake_rows - CASE WHEN source_rows >= 0 THEN source_rows ELSE baseline_rows END WHEN kind <> 'l' THEN baseline_rows - lake_rows WHEN m = 'lake_mismatch' THEN lake_rows - rows_loaded ELSE source_rows - copied END AS diff,
  CASE WHEN kind = 's' AND m = 'ok' AND source_rows >= 0 THEN source_rows - lake_rows END AS pending_gap
FROM (SELECT *, CASE WHEN kind = 's' THEN CASE WHEN baseline_rows < 0 OR lake_rows < 0 THEN 'unknown'
      WHEN lake_rows < baseline_rows AND (baseline_rows <= 10000000 OR baseline_rows - lake_rows > baseline_rows * 0.0001) THEN 'incomplete_copy'
      WHEN source_rows > 0 AND lake_rows - source_rows > source_rows * 0.05 THEN 'duplicate_load' WHEN source_rows < 0 AND baseline_rows > 0 AND lake_rows - baseline_rows > baseline_rows * 0.05 THEN 'duplicate_load' ELSE 'ok' END
    WHEN kind = 'b' THEN CASE WHEN baseline_rows < 0 OR lake_rows < 0 OR baseline_rows = lake_rows OR (baseline_rows > 10000000 AND abs(baseline_rows - lake_rows) <= baseline_rows * 0.0001) THEN 'ok' ELSE 'row_mismatch' END
    WHEN NOT (source_rows < 0 OR copied < 0 OR source_rows = copied OR (source_rows > 10000000 AND abs(source_rows - copied) <= source_rows * 0.0001)) THEN 'row_mismatch'
    WHEN rows_loaded > 0 AND lake_rows >= 0 AND NOT (lake_rows = rows_loaded OR (lake_rows > 10000000 AND abs(lake_rows - rows_loaded) <= lake_rows * 0.0001)) THEN 'lake_mismatch' ELSE 'ok' END AS m
  FROM (SELECT *, CASE WHEN baseline_rows IS NOT NULL AND reconciles THEN 's' WHEN baseline_rows IS NOT NULL THEN 'b' ELSE 'l' END AS kind, CASE WHEN rows_loaded > 0 THEN rows_loaded ELSE lake_rows END AS copied FROM loads) f) g"""


@query("load_verify", _VERIFIED)
def _(t):
    return ld.verify(t.loads)


@query("load_baseline_pick", "SELECT catalog_id, arg_min(source_rows, (CASE phase WHEN 'truncate' THEN 0 WHEN 'copy' THEN 1 ELSE 2 END) * 100 + worker_id) AS baseline_rows FROM checkpoints GROUP BY 1")
def _(t):
    return ld.baseline(t.checkpoints)


@query("load_window_replay", "SELECT * FROM mirror0 WHERE user_id NOT IN (SELECT user_id FROM changes WHERE pos >= part * 100) UNION ALL SELECT user_id, event_type, cents FROM (SELECT * FROM changes WHERE pos >= part * 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) = 1) WHERE op <> 'd'")
def _(t):
    marks = t.changes.select("topic", "part", (F.col("part") * 100).alias("bookmark")).distinct()
    return ld.window_replay(t.mirror0, t.changes, marks, ["user_id"], ["event_type", "cents"])


@query("load_modes", "SELECT catalog_id, CASE snapshot_mode WHEN 'never' THEN 'skip' WHEN 'schema_only' THEN 'create' WHEN 'incremental' THEN 'merge' ELSE 'truncate_copy' END AS action FROM catalog")
def _(t):
    return ld.load_action(t.catalog)


# ---------------------------------------------------------------- drift

derive("src_cols", "SELECT c_custkey AS tab, 'c' || CAST(r_regionkey AS STRING) AS name, r_regionkey % 2 = 0 AS nullable, r_regionkey AS place FROM customer JOIN region ON r_regionkey < 5 WHERE c_custkey % 9 <> 0 AND (c_custkey % 4 <> 1 OR r_regionkey <> 2) AND (c_custkey % 6 <> 2 OR r_regionkey <> 0)")
derive("lake_cols", "SELECT c_custkey AS tab, 'c' || CAST(r_regionkey AS STRING) AS name, c_custkey % 3 <> 0 AS nullable FROM customer JOIN region ON r_regionkey < 5 WHERE c_custkey % 5 <> 1 OR r_regionkey <> 4")
derive("pk_cols", "SELECT c_custkey AS tab, 'c0' AS name FROM customer")
DRIFT = "SELECT c_custkey AS tab, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 5 <> 1 THEN '' ELSE 'c4' END AS added, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat_ws('+', CASE WHEN c_custkey % 6 = 2 THEN 'c0' END, CASE WHEN c_custkey % 4 = 1 THEN 'c2' END) END AS removed, c_custkey % 9 <> 0 AND c_custkey % 6 = 2 AS pk_removed, c_custkey % 9 = 0 AS source_unavailable FROM customer"


@query("drift_plan", f"SELECT *, added <> '' AND removed <> '' AS ambiguous FROM ({DRIFT})")
def _(t):
    p = d.plan(t.src_cols, t.lake_cols, t.pk_cols)
    return p.withColumns({"added": F.array_join("added", "+"), "removed": F.array_join("removed", "+")})


REASON = "CASE WHEN pk_removed THEN 'key column dropped: ' || replace(removed, '+', ', ') WHEN added <> '' AND removed <> '' THEN 'possible rename, added: ' || added || '; dropped: ' || replace(removed, '+', ', ') END"


@query("drift_reason", f"SELECT tab, {REASON} AS reason FROM ({DRIFT})")
def _(t):
    return d.action(d.plan(t.src_cols, t.lake_cols, t.pk_cols)).select("tab", "reason")


@query("drift_action", f"SELECT tab, CASE WHEN source_unavailable THEN 'wait' WHEN {REASON} IS NOT NULL THEN 'reload' WHEN removed <> '' THEN 'drop_columns' WHEN added <> '' THEN 'add_columns' ELSE 'none' END AS action FROM ({DRIFT})")
def _(t):
    return d.action(d.plan(t.src_cols, t.lake_cols, t.pk_cols)).select("tab", "action")


@query("drift_drop_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment AS _dl_source_system FROM customer")
def _(t):
    rows = t.customer.withColumnRenamed("c_mktsegment", "_dl_source_system")
    return d.drop_columns(rows, ["c_acctbal", "c_custkey", "_dl_source_system"], ["c_custkey"])


derive("type_pairs", "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'VARCHAR(20)' WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'TEXT' ELSE 'DATE' END AS old, CASE p_partkey % 6 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'VARCHAR(' || CAST(p_size AS STRING) || ')' WHEN 2 THEN 'SMALLINT' WHEN 3 THEN 'TEXT' WHEN 4 THEN 'TIMESTAMPTZ' ELSE 'UUID' END AS new, p_size FROM part")


@query("type_width_family", "SELECT k, CASE WHEN old = new THEN 'same' WHEN old = 'INTEGER' AND new = 'BIGINT' THEN 'widen' WHEN old IN ('INTEGER', 'BIGINT') AND new = 'SMALLINT' THEN 'narrow' WHEN old = 'VARCHAR(20)' AND new = 'TEXT' THEN 'widen' WHEN old = 'TEXT' AND new LIKE 'VARCHAR%' THEN 'narrow' WHEN old = 'VARCHAR(20)' AND new LIKE 'VARCHAR%' THEN CASE WHEN p_size >= 20 THEN 'widen' ELSE 'narrow' END WHEN old = 'DATE' AND new = 'TIMESTAMPTZ' THEN 'widen' ELSE 'reload' END AS kind FROM type_pairs")
def _(t):
    return t.type_pairs.select("k", d.width_family(F.col("old"), F.col("new")).alias("kind"))


@query("type_migrate_check", "SELECT 'tok' AS name, count(*) FILTER (tok IS NOT NULL AND NOT regexp_full_match(trim(tok), '-?[0-9]+')) AS bad, false AS fits FROM tokens UNION ALL SELECT 'num', 0, true FROM (SELECT 1)")
def _(t):
    rows = t.tokens.select("tok", F.col("e").cast("string").alias("num"))
    return d.migrate_check(rows, {"tok": "int", "num": "bigint"})


@query("type_binary_text", "SELECT e, lower(hex(t)) AS h, CASE WHEN e % 2 = 0 THEN t END AS back FROM ev")
def _(t):
    raw = F.when(F.col("e") % 2 == 0, d.text_to_binary(F.col("t"))).otherwise(F.unhex(F.lit("ff00")))
    return t.ev.select("e", F.lower(F.hex(d.text_to_binary(F.col("t")))).alias("h"), d.binary_to_text(raw).alias("back"))


@query("nullability_merge", "SELECT s.tab, s.name, s.nullable AND coalesce(l.nullable, true) AND s.name <> 'c0' AS nullable FROM src_cols s LEFT JOIN lake_cols l ON l.tab = s.tab AND l.name = s.name")
def _(t):
    return d.nullability(t.src_cols.select("tab", "name", "nullable"), t.lake_cols, t.pk_cols)


derive("audit_cols", "SELECT c_custkey AS tab, 'c' || CAST(r_regionkey AS STRING) AS name, CASE r_regionkey WHEN 0 THEN 'bit(1)' WHEN 1 THEN 'datetime2' WHEN 2 THEN 'int' WHEN 3 THEN 'TEXT' ELSE 'tinyint(1)' END AS declared, 'A' AS expected, CASE WHEN c_custkey % 4 = 0 THEN 'B' ELSE 'A' END AS lake_type, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 2 END AS rule_version FROM customer JOIN region ON r_regionkey < 5")
FOUND = "SELECT tab, name, CASE WHEN lake_type <> expected THEN 'type_mismatch' ELSE 'stale_rules' END AS finding FROM audit_cols WHERE name NOT IN ('c2', 'c3') AND (rule_version < 2 OR lake_type <> expected)"


@query("coercion_audit", FOUND)
def _(t):
    return d.coercion_audit(t.audit_cols, 2)[0]


@query("coercion_audit_tables", f"SELECT tab, count(*) AS findings, string_agg(name, ',' ORDER BY name) AS report FROM ({FOUND}) GROUP BY 1")
def _(t):
    return d.coercion_audit(t.audit_cols, 2)[1]


@query("catalog_discover", "SELECT k, CASE WHEN k % 11 = 0 THEN 'prune' WHEN k % 13 = 5 THEN 'add' ELSE 'keep' END AS fate FROM (SELECT o_orderkey AS k FROM orders) WHERE NOT (k % 11 = 0 AND k % 13 = 5)")
def _(t):
    return d.discover(t.before_rows, t.after_rows, ["k"])


@query("catalog_cascade", "SELECT catalog_id FROM apply_position WHERE catalog_id NOT IN (SELECT catalog_id FROM catalog WHERE NOT active)")
def _(t):
    return d.cascade(t.apply_position, t.catalog.where("not active")).select("catalog_id")


@query("catalog_pk_list", "SELECT tab, string_agg(name, ',' ORDER BY place DESC) AS pk_columns, true AS has_pk FROM src_cols GROUP BY 1")
def _(t):
    return d.key_list(t.src_cols.select("tab", "name", (-F.col("place")).alias("place")))
