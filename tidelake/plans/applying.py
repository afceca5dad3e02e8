"""Applying changes, and history."""

from pyspark.sql import functions as F

from ..operators import apply as a
from ..operators import history as h
from .registry import derive, query

derive("batch", "SELECT * FROM changes WHERE pos % 3 <> 1")
derive("mirror0", "SELECT c_custkey AS user_id, 'seed' AS event_type, c_custkey * 10 AS cents FROM customer")
derive("last_change", "SELECT topic, part, pos, event_id, op, catalog_id, user_id, event_type, cents, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) AS nth FROM changes) x WHERE nth = 1")
derive("upserts", "SELECT user_id, CASE WHEN pos % 2 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN pos % 3 = 0 THEN NULL ELSE cents END AS cents FROM last_change")
#: Chains of 36 through all customers' tables, and a cycle of two.
derive("fk_edges", "SELECT 't' || CAST(c_custkey AS STRING) AS child, 't' || CAST(c_custkey - 1 AS STRING) AS parent FROM customer WHERE c_custkey % 36 <> 0 UNION ALL SELECT 'ta', 'tb' FROM region UNION ALL SELECT 'tb', 'ta' FROM region")
derive("fk_tables", "SELECT 't' || CAST(c_custkey AS STRING) AS name FROM customer UNION ALL SELECT 'ta' FROM region UNION ALL SELECT 'tb' FROM region")
KEY, DATA = ["user_id"], ["event_type", "cents"]


def twice(t):
    return t.changes.unionByName(t.batch)


#: The log, part of it delivered again elsewhere, and second changes under the ids of first ones.
derive("redelivered", "SELECT topic, part, pos, event_id, op, catalog_id, user_id, event_type, cents, ts_ms FROM changes UNION ALL SELECT topic, part, pos + 10000000, event_id, op, catalog_id, user_id, event_type, cents, ts_ms + 5 FROM changes WHERE pos % 3 = 0 UNION ALL SELECT topic, part, pos + 20000000, event_id, op, catalog_id, user_id, event_type, cents + 1, ts_ms FROM changes WHERE pos % 7 = 0")


@query("apply_dedup", "SELECT catalog_id, event_id, pos, cents FROM changes WHERE pos % 5 <> 0 UNION ALL SELECT catalog_id, event_id, pos + 20000000, cents + 1 FROM changes WHERE pos % 7 = 0")
def _(t):
    return a.dedup(t.redelivered, a.ledger_rows(t.changes.where("pos % 5 = 0"))).select("catalog_id", "event_id", "pos", "cents")


@query("apply_missing_pk", "SELECT catalog_id, count(*) FILTER (user_id % 7 = 0 AND op = 'd') AS lost_deletes, count(*) FILTER (user_id % 7 = 0 AND op <> 'd') AS lost_upserts, count(*) FILTER (user_id % 7 <> 0) AS kept FROM changes GROUP BY 1")
def _(t):
    return a.missing_key_counts(t.changes.withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id"))), KEY)


@query("apply_latest_per_key", "SELECT user_id, op, event_type, cents, pos FROM last_change")
def _(t):
    return a.latest_per_key(t.changes, KEY).select("user_id", "op", "event_type", "cents", "pos")


@query("apply_delete", "SELECT * FROM mirror0 WHERE user_id NOT IN (SELECT user_id FROM last_change WHERE op = 'd')")
def _(t):
    return a.delete(t.mirror0, a.survivors(t.changes, KEY)[1], KEY)


@query("apply_upsert", "SELECT * FROM mirror0 WHERE user_id NOT IN (SELECT user_id FROM last_change WHERE op <> 'd') UNION ALL SELECT user_id, event_type, cents FROM last_change WHERE op <> 'd'")
def _(t):
    return a.upsert(t.mirror0, a.survivors(t.changes, KEY)[0].select("user_id", "event_type", "cents"), KEY)


MIRROR = "SELECT * FROM mirror0 WHERE user_id NOT IN (SELECT user_id FROM changes) UNION ALL SELECT user_id, event_type, cents FROM last_change WHERE op <> 'd'"


@query("apply_batch", MIRROR)
def _(t):
    return a.apply_batch(t.mirror0, twice(t), KEY, DATA)


@query("apply_batch_deletes_first", "SELECT * FROM mirror0 WHERE user_id NOT IN (SELECT user_id FROM changes) UNION ALL SELECT user_id, event_type, cents FROM (SELECT * FROM changes WHERE op <> 'd' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) = 1)")
def _(t):
    return a.apply_batch(t.mirror0, t.changes, KEY, DATA, order="deletes_first")


@query("flagship_mirror", f"SELECT m.user_id, c.c_name, m.event_type, m.cents, n.changes, n.deletes FROM ({MIRROR}) m JOIN customer c ON c.c_custkey = m.user_id LEFT JOIN (SELECT user_id, count(*) AS changes, count(*) FILTER (op = 'd') AS deletes FROM changes GROUP BY 1) n ON n.user_id = m.user_id")
def flagship(t):
    mirror = a.apply_batch(t.mirror0, t.changes, KEY, DATA)
    counts = t.changes.groupBy("user_id").agg(F.count("*").alias("changes"), F.count_if(F.col("op") == "d").alias("deletes"))
    names = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    return mirror.join(names, "user_id").join(counts, "user_id", "left").select("user_id", "c_name", "event_type", "cents", "changes", "deletes")


@query("apply_load_columns", "SELECT catalog_id, pos, ts_ms + row_number() OVER (PARTITION BY catalog_id ORDER BY part, pos) - 1 AS _dl_load_ms, strftime(make_timestamp((ts_ms + row_number() OVER (PARTITION BY catalog_id ORDER BY part, pos) - 1) * 1000), '%Y-%m-%d') AS _dl_load_date, 'mariadb' AS _dl_source_system, 'snap' AS _dl_snapshot_id FROM changes")
def _(t):
    return a.load_columns(t.changes, "ts_ms", "mariadb", "snap").select("catalog_id", "pos", "_dl_load_ms", "_dl_load_date", "_dl_source_system", "_dl_snapshot_id")


@query("apply_add_columns", "SELECT * FROM (SELECT 'f' || CAST(e % 9 AS STRING) AS name, count(*) AS rows FROM ev GROUP BY 1 UNION ALL SELECT 'k', count(*) FROM ev WHERE e % 2 = 0) WHERE name NOT IN ('f1', 'f2')")
def _(t):
    m = F.map_filter(F.create_map(F.concat(F.lit("f"), (F.col("e") % 9).cast("string")), F.lit(1), F.lit("k"), F.when(F.col("e") % 2 == 0, 1), F.lit("_dl_load_date"), F.lit(2)), lambda _, v: v.isNotNull())
    return a.new_columns(["f1", "f2"], t.ev.select(m.alias("m")), "m")


@query("apply_widen_int", "SELECT 'cents' AS name, max(cents) > 2147483647 AS widen FROM ev UNION ALL SELECT 'ms', max(ms) > 2147483647 FROM ev UNION ALL SELECT 'u', max(u) > 2147483647 FROM ev")
def _(t):
    return a.widen_ints(t.ev, ["cents", "ms", "u"])


def checked(t):
    rules = {"cents_range": (F.col("cents") < 30_000, "22003"), "type_known": (F.col("event_type") != "view", "23514")}
    return a.check_rows(t.changes, rules)


BAD = "cents >= 30000 OR event_type = 'view'"


@query("apply_dlq_split", f"SELECT pos, (CASE WHEN cents >= 30000 THEN 'cents_range ' ELSE '' END) || (CASE WHEN event_type = 'view' THEN 'type_known ' ELSE '' END) AS broken FROM changes WHERE {BAD}")
def _(t):
    _, bad, _ = a.dlq_split(checked(t))
    return bad.select("pos", F.concat_ws("", F.transform("_errors", lambda e: F.concat(e["rule"], F.lit(" ")))).alias("broken"))


@query("apply_dlq_quarantine", f"SELECT catalog_id, count(*) AS parked FROM changes WHERE {BAD} GROUP BY 1 HAVING count(*) > 50")
def _(t):
    return a.dlq_split(checked(t))[2]


@query("apply_error_class", "SELECT dlq_id, CASE WHEN error_sqlstate IN ('40P01', '08006', '57014') THEN false WHEN error_sqlstate <> '' THEN error_sqlstate IN ('22003', '23514') ELSE error_message IN ('new row violates check', 'value too long for type') END AS deterministic FROM dlq")
def _(t):
    return t.dlq.select("dlq_id", a.deterministic(F.col("error_sqlstate"), F.col("error_message")).alias("deterministic"))


@query("apply_op_counts", "SELECT catalog_id, count(*) FILTER (op = 'c') AS inserts, count(*) FILTER (op = 'u') AS updates, count(*) FILTER (op = 'd') AS deletes FROM changes GROUP BY 1")
def _(t):
    return a.op_counts(t.changes, ["catalog_id"])


@query("apply_position", "SELECT catalog_id, topic, part, pos, event_id, (SELECT max(ts_ms) FROM changes x WHERE x.catalog_id = c.catalog_id) AS last_ms FROM changes c WHERE catalog_id <> 2 QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY pos DESC, part DESC) = 1")
def _(t):
    return a.positions(t.changes, t.changes.where("catalog_id = 2").select("catalog_id"))


@query("apply_stats", "SELECT catalog_id, count(*) FILTER (op = 'c') AS inserts, count(*) FILTER (op = 'u') AS updates, count(*) FILTER (op = 'd') AS deletes, count(*) AS events_total, 7000 AS duration_ms, count(*) * 60000 // 7000 AS events_per_minute FROM changes GROUP BY 1")
def _(t):
    return a.batch_stats(t.changes, 1000, 8000)


COMMIT = "SELECT topic, part, max(pos) AS pos FROM changes GROUP BY 1, 2"


@query("apply_commit_offsets", f"SELECT * FROM ({COMMIT}) WHERE NOT (part = 3)")
def _(t):
    return a.commit_offsets(t.changes, t.changes.where("part = 3"))


@query("quarantine_hold", f"SELECT c.topic, c.part, least(c.pos, coalesce(h.hold - 1, c.pos)) AS pos FROM ({COMMIT}) c LEFT JOIN (SELECT topic, part, min(pos) AS hold FROM changes WHERE catalog_id = 1 GROUP BY 1, 2) h ON h.topic = c.topic AND h.part = c.part WHERE coalesce(h.hold > 0, true)")
def _(t):
    return a.quarantine_hold(a.commit_offsets(t.changes, t.changes.where("1 = 0")), t.changes.where("catalog_id = 1"))


@query("replay_plan", "SELECT kafka_topic, kafka_partition, min(kafka_offset) AS start_offset, count(*) AS tables FROM apply_position WHERE replay_requested GROUP BY 1, 2")
def _(t):
    return a.replay_plan(t.apply_position)


@query("apply_reselect", "SELECT u.user_id, coalesce(u.event_type, m.event_type) AS event_type, coalesce(u.cents, m.cents) AS cents FROM upserts u LEFT JOIN mirror0 m ON m.user_id = u.user_id")
def _(t):
    return a.reselect(t.upserts, t.mirror0, KEY, DATA)


@query("apply_audit", "SELECT catalog_id, event_id, op, topic, part, pos, 'b1' AS batch_id FROM changes")
def _(t):
    return a.audit(t.changes, "b1")


@query("table_fk_levels", "SELECT 't' || c_custkey AS name, CAST(c_custkey % 36 AS INT) AS level FROM customer UNION ALL SELECT DISTINCT x, CAST(NULL AS INT) FROM region, (VALUES ('ta'), ('tb')) v(x)")
def _(t):
    return a.table_levels(t.fk_tables, t.fk_edges)


@query("mirror_dedupe", "SELECT user_id, event_type, cents, ts_ms FROM changes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_type DESC, cents DESC) = 1")
def _(t):
    return a.newest_version(t.changes.select("user_id", "event_type", "cents", "ts_ms"), KEY, "ts_ms")


@query("reconcile_counts", "SELECT coalesce(a.s, b.s) AS s, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS mirror_rows, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT s, count(*) AS n FROM after_rows GROUP BY 1) a FULL JOIN (SELECT s, count(*) AS n FROM before_rows GROUP BY 1) b ON a.s = b.s")
def _(t):
    return a.reconcile(t.after_rows, t.before_rows, ["s"])


@query("reconcile_keys", "SELECT k, 'source' AS side FROM after_rows WHERE k % 13 = 5 UNION ALL SELECT k, 'mirror' FROM before_rows WHERE k % 11 = 0")
def _(t):
    return a.key_diff(t.after_rows, t.before_rows, ["k"])


# ---------------------------------------------------------------- history

derive("staged", "SELECT user_id, pos, ts_ms, CASE WHEN op = 'd' THEN NULL ELSE event_type END AS event_type, CASE WHEN op = 'd' THEN NULL ELSE cents % 3 END AS band, op = 'd' AS deleted FROM changes")
derive("real_steps", "SELECT * FROM (SELECT *, row_number() OVER w AS nth, lag(event_type) OVER w AS pe, lag(band) OVER w AS pb, lag(deleted) OVER w AS pd FROM staged WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, pos)) WHERE nth = 1 OR pe IS DISTINCT FROM event_type OR pb IS DISTINCT FROM band OR pd IS DISTINCT FROM deleted")
derive("hist", "SELECT user_id, event_type, band, ts_ms AS valid_from, nxt AS valid_to, nxt IS NULL AS is_current, coalesce(nd, false) AS is_deleted FROM (SELECT *, lead(ts_ms) OVER w AS nxt, lead(deleted) OVER w AS nd FROM real_steps WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, pos)) WHERE NOT deleted")
HDATA = ["event_type", "band"]


def hist(t):
    return h.record(t.changes.withColumn("band", F.col("cents") % 3), ["user_id"], HDATA)


@query("scd2_record", "SELECT * FROM hist")
def _(t):
    return hist(t)


@query("scd2_delete", "SELECT user_id, event_type, band, valid_from, CASE WHEN hit THEN d ELSE valid_to END AS valid_to, is_current AND NOT hit AS is_current, is_deleted OR hit AS is_deleted FROM (SELECT h.*, CASE WHEN user_id % 3 = 0 THEN {as_of} - user_id * 86400000 END AS d, is_current AND coalesce(user_id % 3 = 0 AND valid_from <= {as_of} - user_id * 86400000, false) AS hit FROM hist h)")
def _(t):
    from .registry import AS_OF

    gone = t.changes.select("user_id").distinct().where("user_id % 3 = 0").withColumn("deleted_at", F.lit(AS_OF) - F.col("user_id") * 86_400_000)
    return h.delete(hist(t), gone, ["user_id"])


@query("scd2_seed", "SELECT h.user_id, h.event_type, h.band, valid_from, CASE WHEN is_current AND s.user_id IS NOT NULL AND (s.event_type IS DISTINCT FROM h.event_type OR s.band IS DISTINCT FROM h.band) THEN {as_of} ELSE valid_to END AS valid_to, is_current AND NOT (s.user_id IS NOT NULL AND (s.event_type IS DISTINCT FROM h.event_type OR s.band IS DISTINCT FROM h.band)) AS is_current, is_deleted FROM hist h LEFT JOIN (SELECT user_id, 'view' AS event_type, user_id % 3 AS band FROM mirror0) s ON s.user_id = h.user_id UNION ALL SELECT s.user_id, s.event_type, s.band, {as_of}, NULL, true, false FROM (SELECT user_id, 'view' AS event_type, user_id % 3 AS band FROM mirror0) s LEFT JOIN hist h ON h.user_id = s.user_id AND h.is_current WHERE h.user_id IS NULL OR h.event_type IS DISTINCT FROM s.event_type OR h.band IS DISTINCT FROM s.band")
def _(t):
    from .registry import AS_OF

    snapshot = t.mirror0.select("user_id", F.lit("view").alias("event_type"), (F.col("user_id") % 3).alias("band"))
    return h.seed(hist(t), snapshot, ["user_id"], HDATA, AS_OF)


@query("scd2_align", "SELECT user_id, valid_from, CAST(NULL AS BIGINT) AS cents FROM hist")
def _(t):
    return h.align(hist(t), t.mirror0).select("user_id", "valid_from", "cents")


@query("scd2_as_of", "SELECT user_id, event_type, band FROM hist WHERE valid_from <= {as_of} - 864000000 AND coalesce(valid_to > {as_of} - 864000000, true)")
def _(t):
    from .registry import AS_OF

    return h.as_of(hist(t), AS_OF - 864_000_000).select("user_id", "event_type", "band")


@query("scd2_as_of_probes", "SELECT e.e, e.u AS user_id, h.event_type, h.band FROM ev e LEFT JOIN hist h ON h.user_id = e.u AND h.valid_from <= e.ms - 3600000 AND coalesce(h.valid_to > e.ms - 3600000, true)")
def _(t):
    probes = t.ev.select("e", F.col("u").alias("user_id"), (F.col("ms") - 3_600_000).alias("at"))
    return h.as_of_probes(hist(t), probes, ["user_id"], "at").select("e", "user_id", "event_type", "band")


@query("scd2_validate", "SELECT user_id, count(*) AS versions, count(*) FILTER (is_current) AS current, 0 AS overlaps, 0 AS gaps FROM hist GROUP BY 1")
def _(t):
    return h.validate(hist(t), ["user_id"])
