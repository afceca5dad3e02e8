"""Sources, sinks, documents, and streams that are run over the whole log and read back."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import documents as dc
from ..sources import changelog as s
from ..sources.lake import LakeTable
from ..sources.scratch import estimated_bytes, scratch_path
from ..streaming import jobs
from ..streaming.commit import DLQ, STATS, Pipeline
from ..streaming.history import HistoryTable
from ..streaming.transactions import assemble, rocksdb
from .applying import DATA, KEY, MIRROR
from .registry import derive, query

SCHEMA = "user_id long, event_type string, cents long"
#: Bytes of a log's file, as Spark estimates its rows (some hundred thousand of them), and the most files of a batch.
FILE_BYTES, MOST_FILES = 4 << 20, 2_000


def scratch(t, name: str) -> str:
    """A new folder that the executors share."""
    return scratch_path(t.spark, name)


def log_stream(t, rows, batches: int = 3):
    """Rows written as a log and read as a stream of some batches; a batch is as many files as its size asks for."""
    path = scratch(t, "log")
    files = min(MOST_FILES, -(-estimated_bytes(rows) // (batches * FILE_BYTES)))
    rows.repartition(batches * files, "user_id").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def finish(q) -> None:
    try:
        q.awaitTermination()
    finally:
        q.stop()


def memory(t, stream, mode: str):
    """All rows that a stream puts out, by way of a table in the shared folder."""
    out = scratch(t, "stream")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(t, "checkpoint")).format("parquet").trigger(availableNow=True).start(out)
    finish(q)
    return t.spark.read.schema(stream.schema).parquet(out)


@query("src_changelog", "SELECT topic, part, count(*) AS messages, count(value) AS filled FROM messages GROUP BY 1, 2")
def _(t):
    path = scratch(t, "messages")
    t.messages.withColumn("key", F.lit(None).cast("string")).write.parquet(path)
    return s.read_messages(t.spark, path).groupBy("topic", "part").agg(F.count("*").alias("messages"), F.count("value").alias("filled"))


@query("src_snapshot", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 1000 OR (o_orderkey >= 5000 AND o_orderkey < 6000) OR o_orderkey >= 14000")
def _(t):
    return s.snapshot_slices(t.orders, "o_orderkey", [(None, 1000), (5000, 6000), (14000, None)]).select("o_orderkey", "o_custkey")


@query("src_mssql_changes", "SELECT CASE e % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 'u' END AS op, lower(lpad(to_hex(e), 8, '0')) AS lsn, '01' AS seqval, u, t FROM ev WHERE e % 4 <> 2")
def _(t):
    rows = t.ev.select((F.col("e") % 4 + 1).cast("int").alias("__$operation"), F.unhex(F.lpad(F.hex("e"), 8, "0")).alias("__$start_lsn"), F.unhex(F.lit("01")).alias("__$seqval"), "u", "t")
    return s.mssql_changes(rows)


MONGO_KINDS = "CASE e % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'replace' ELSE 'drop' END"
MONGO_TIME = "CASE e % 3 WHEN 0 THEN '\"clusterTime\":{\"i\":1,\"t\":' || CAST(e AS STRING) || '}' WHEN 1 THEN '\"wallTime\":' || CAST(ms AS STRING) ELSE '\"x\":1' END"
derive("stream_docs", f"SELECT e, '{{\"_id\":{{\"_data\":\"tok' || CAST(e AS STRING) || '\"}},\"operationType\":\"' || {MONGO_KINDS} || '\",\"documentKey\":{{\"_id\":{{\"$oid\":\"o' || CAST(u AS STRING) || '\"}}}},\"fullDocument\":{{\"_id\":{{\"$oid\":\"o' || CAST(u AS STRING) || '\"}},\"A\":{{\"t\":\"' || t || '\"}}}},' || {MONGO_TIME} || '}}' AS text FROM ev")


@query("src_mongo_changes", "SELECT e, CASE e % 5 WHEN 1 THEN 'u' WHEN 2 THEN 'd' ELSE 'c' END AS op, 'o' || u AS id, 'o' || u AS mongo_id, CASE WHEN e % 5 <> 2 THEN t END AS a_t, CASE e % 3 WHEN 0 THEN '{\"i\":1,\"t\":' || e || '}' WHEN 1 THEN CAST(ms AS STRING) ELSE '{\"_data\":\"tok' || e || '\"}' END AS at FROM ev WHERE e % 5 <> 4")
def _(t):
    rows = s.flat_changes(t.stream_docs.select("e", F.parse_json("text").alias("doc")), "e", "doc")
    return rows.select("e", "op", "id", F.col("row")["mongo_id"].alias("mongo_id"), F.try_element_at("row", F.lit("a_t")).alias("a_t"), "at")


@query("src_row_events", "SELECT pos, op, CASE WHEN op <> 'd' THEN user_id END AS id_after, CASE WHEN op <> 'c' THEN user_id + 1 END AS id_before FROM changes")
def _(t):
    kind = F.when(F.col("op") == "c", "Insert").when(F.col("op") == "u", "UPDATE").otherwise("delete")
    rows = t.changes.select("pos", kind.alias("kind"), F.array(F.lit("id")).alias("cols"), F.array("user_id").alias("vals"), F.array(F.col("user_id") + 1).alias("olds"))
    return s.row_events(rows).select("pos", "op", F.col("after")["id"].alias("id_after"), F.col("before")["id"].alias("id_before"))


@query("sink_changelog", "SELECT topic, part, pos, CAST(user_id AS STRING) AS key, event_type AS value, false AS tombstone FROM changes UNION ALL SELECT topic, part, pos, CAST(user_id AS STRING), NULL, true FROM changes WHERE op = 'd'")
def _(t):
    return s.to_messages(t.changes, F.col("topic"), F.col("part"), F.col("user_id").cast("string"), F.col("event_type"))


@query("sink_mirror", "SELECT strftime(make_timestamp(ts_ms * 1000), '%Y_%m') AS _dl_month, count(*) AS rows, sum(cents)::BIGINT AS cents FROM changes GROUP BY 1")
def _(t):
    path = scratch(t, "mirror")
    s.write_mirror(t.changes.withColumn("_dl_load_ms", F.col("ts_ms")), path)
    return t.spark.read.parquet(path).groupBy("_dl_month").agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"))


@query("sink_history", "SELECT user_id, valid_from, valid_to, is_current, is_deleted FROM hist")
def _(t):
    from .applying import hist

    path = scratch(t, "history")
    s.write_mirror(hist(t), path, "valid_from")
    return t.spark.read.parquet(path).select("user_id", "valid_from", "valid_to", "is_current", "is_deleted")


@query("sink_dlq", "SELECT pos, event_id FROM changes WHERE cents >= 30000 OR event_type = 'view'")
def _(t):
    from ..operators import apply as a
    from .applying import checked

    path = scratch(t, "dlq")
    _, bad, _ = a.dlq_split(checked(t))
    for part in (bad.where("pos % 2 = 0"), bad.where("pos % 2 = 1")):
        s.append(part, path)
    return t.spark.read.parquet(path).select("pos", "event_id")


@query("sink_stats", "SELECT catalog_id, count(*) AS events_total FROM changes GROUP BY 1")
def _(t):
    from ..operators import apply as a

    path = scratch(t, "stats")
    s.append(a.batch_stats(t.changes, 0, 5000), path)
    return t.spark.read.parquet(path).select("catalog_id", "events_total")


# ---------------------------------------------------------------- documents

_DEEP = "repeat('{\"k\":', 30) || CAST(u AS STRING) || repeat('}', 30)"
_LONG = "repeat('a } ' || chr(92) || '\" { ', 100000)"
_ESCAPED = "chr(92) || '\"}}' || chr(92)"
derive("docs_json", "SELECT e, '{\"_id\":' || CASE WHEN e % 3 = 0 THEN '{\"$oid\":\"o' || CAST(e AS STRING) || '\"}' WHEN e % 3 = 1 THEN '\"s' || CAST(e AS STRING) || '\"' ELSE CAST(e AS STRING) END || ',\"User Name\":{\"Id\":' || CAST(u AS STRING) || ',\"_id\":7,\"x\":{\"t\":\"' || t || '\"}},\"tags\":[1,{\"a\":{}}],\"A-b\":1,\"A_b\":2,\"none\":{},\"nil\":null,\"1x\":\"}{\",\"q\":\"x' || " + _ESCAPED + " || '\"y\"' || CASE WHEN e % 5000 = 7 THEN ',\"long\":\"' || " + _LONG + " || '\"' ELSE '' END || CASE WHEN e % 500 = 9 THEN ',\"deep\":' || " + _DEEP + " ELSE '' END || ',\"a\":{\"b\":{\"c\":{\"d\":{\"e\":{\"f\":{\"g\":' || CAST(u AS STRING) || '}}}}}}}}' AS text FROM ev")


@query("doc_flatten", "SELECT e AS id, 'mongo_id' AS name, CASE e % 3 WHEN 0 THEN 'o' WHEN 1 THEN 's' ELSE '' END || e AS value FROM ev UNION ALL SELECT e, 'user_name_id', CAST(u AS STRING) FROM ev UNION ALL SELECT e, 'user_name_x_t', t FROM ev UNION ALL SELECT e, 'tags', '[1,{\"a\":{}}]' FROM ev UNION ALL SELECT e, 'a_b', '1' FROM ev UNION ALL SELECT e, 'a_b_' || substr(md5(chr(1) || 'A_b'), 1, 8), '2' FROM ev UNION ALL SELECT e, 'nil', NULL FROM ev UNION ALL SELECT e, 't_1x', '}{' FROM ev UNION ALL SELECT e, 'a_b_c_d_e_f_g', CAST(u AS STRING) FROM ev UNION ALL SELECT e, 'q', 'x\"}}\"y' FROM ev UNION ALL SELECT e, 'long', md5(repeat('a } \" { ', 100000)) FROM ev WHERE e % 5000 = 7 UNION ALL SELECT e, substr('deep' || repeat('_k', 30), 1, 63), CAST(u AS STRING) FROM ev WHERE e % 500 = 9")
def _(t):
    """With quotes and braces in texts, texts of a megabyte, objects 30 deep, and an id column named id."""
    leaves = dc.flatten(t.docs_json.select(F.col("e").alias("id"), F.parse_json("text").alias("doc")), "id", "doc")
    return leaves.withColumn("value", F.when(F.length("value") > 1000, F.md5(F.col("value").cast("binary"))).otherwise(F.col("value")))


@query("doc_pivot", "SELECT e, u AS user_id, t AS kind, CAST(NULL AS BIGINT) AS gone FROM ev")
def _(t):
    return dc.pivot(t.docs_json.select("e", F.parse_json("text").alias("doc")), "e", "doc", {"user_id": ("$['User Name'].Id", "long"), "kind": ("$['User Name'].x.t", "string"), "gone": ("$.nothing", "long")})


derive("known_types", "SELECT 'c' || CAST(c_custkey AS STRING) AS name, CASE c_custkey % 4 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'JSONB' ELSE 'DOUBLE' END AS type FROM customer WHERE c_custkey % 7 <> 0")
derive("batch_types", "SELECT 'c' || CAST(c_custkey AS STRING) AS name, CASE c_custkey % 3 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'TEXT' ELSE 'INTEGER' END AS type FROM customer WHERE c_custkey % 5 <> 0")


@query("doc_schema_merge", "SELECT name, type, CASE WHEN old IS NULL THEN 'added' WHEN type <> old THEN 'widened' ELSE 'kept' END AS change FROM (SELECT coalesce(a.name, b.name) AS name, a.type AS old, CASE WHEN a.type IS NULL THEN b.type WHEN b.type IS NULL OR a.type = b.type THEN a.type WHEN a.type = 'JSONB' THEN 'JSONB' WHEN a.type = 'TEXT' OR b.type = 'TEXT' THEN 'TEXT' WHEN a.type = 'DOUBLE' THEN 'DOUBLE' ELSE 'BIGINT' END AS type FROM known_types a FULL JOIN batch_types b ON a.name = b.name)")
def _(t):
    return dc.merge_schema(t.known_types, t.batch_types)


@query("lineage_emit", "SELECT lineage_id, 'RUN' AS event_type, 'apply' AS job_name, 'r' || lineage_id AS run_id, 2 AS inputs, 'mirror' AS output FROM lineage")
def _(t):
    x = dc.lineage_event("RUN", "apply", F.concat(F.lit("r"), F.col("lineage_id").cast("string")), [("bus", "a"), ("bus", "b")], [("lake", "mirror")])
    return t.lineage.select("lineage_id", x.alias("x")).select("lineage_id", "x.event_type", "x.job_name", "x.run_id", F.size("x.inputs").alias("inputs"), F.col("x.outputs")[0]["name"].alias("output"))


# ---------------------------------------------------------------- streams


@query("stream_apply", MIRROR)
def _(t):
    table = LakeTable(t.spark, scratch(t, "lake"), KEY, SCHEMA, buckets=4)
    table.merge(t.mirror0.select(*KEY, *DATA, F.lit("c").alias("op"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos")), DATA, -0)
    shifted = LakeTable(t.spark, table.path, KEY, SCHEMA, buckets=4)
    merge = shifted.merge
    shifted.merge = lambda rows, data, version: merge(rows, data, version + 1)
    finish(jobs.stream_apply(log_stream(t, t.changes), shifted, DATA, scratch(t, "checkpoint"), ledger=scratch(t, "ledger")))
    return table.read()


#: Raw messages of five tables, one of them unknown: tombstones, garbage, changes without a key, a column that only some
#: changes have, numbers of 64 bits, and messages that come again.
_BODY = "'{\"op\":\"' || op || '\",\"source_schema\":\"s\",\"source_table\":\"t' || CAST(user_id % 5 AS STRING) || '\",\"ts_ms\":' || CAST(ts_ms AS STRING) || ',\"source\":{\"gtid\":\"g' || CAST(pos AS STRING) || '\"},\"' || CASE WHEN op = 'd' THEN 'before' ELSE 'after' END || '\":{' || CASE WHEN pos % 17 = 0 THEN '' ELSE '\"id\":' || CAST(user_id AS STRING) || ',' END || '\"kind\":\"' || event_type || '\",\"c\":' || CAST(c AS STRING) || CASE WHEN pos % 3 = 0 THEN ',\"extra\":\"x' || CAST(pos % 7 AS STRING) || '\"' ELSE '' END || '}}'"
derive("bus_rows", "SELECT topic, part, pos, op, event_type, user_id, user_id % 5 AS tid, ts_ms, CASE WHEN pos % 19 = 0 THEN cents * 1000000000 ELSE cents END AS c FROM changes")
derive("bus_log", f"SELECT topic, part, pos, user_id, CASE WHEN pos % 11 = 0 THEN NULL WHEN pos % 13 = 0 THEN 'garbage' ELSE {_BODY} END AS value FROM bus_rows UNION ALL SELECT topic, part, pos + 10000000, user_id, CASE WHEN pos % 11 = 0 THEN NULL WHEN pos % 13 = 0 THEN 'garbage' ELSE {_BODY} END FROM bus_rows WHERE pos % 7 = 0")
_ALL = "(SELECT pos, pos AS e, part, topic, tid, op, user_id, event_type, c FROM bus_rows UNION ALL SELECT pos + 10000000, pos, part, topic, tid, op, user_id, event_type, c FROM bus_rows WHERE pos % 7 = 0)"
_GOOD = "(SELECT * FROM bus_rows WHERE pos % 11 <> 0 AND pos % 13 <> 0 AND pos % 17 <> 0 AND tid < 4)"
COMMITTED = f"""SELECT 'mirror' AS side, tid AS a, user_id AS b, c, event_type || '/' || CASE WHEN pos % 3 = 0 THEN 'x' || (pos % 7) ELSE '-' END AS s FROM {_GOOD} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) = 1 AND op <> 'd'
UNION ALL SELECT 'ledger', tid, count(*), NULL, NULL FROM {_GOOD} GROUP BY tid
UNION ALL SELECT 'dlq', CASE WHEN tid = 4 THEN -1 ELSE tid END, count(*), NULL, NULL FROM {_ALL} WHERE e % 11 <> 0 AND e % 13 <> 0 AND (tid = 4 OR e % 17 = 0) GROUP BY 2
UNION ALL SELECT 'stats', CASE WHEN tid = 4 OR e % 11 = 0 OR e % 13 = 0 THEN -1 ELSE tid END, count(*), count(*) FILTER (e % 11 = 0 OR e % 13 = 0), NULL FROM {_ALL} GROUP BY 2
UNION ALL SELECT 'position', tid, max(pos), NULL, NULL FROM (SELECT tid, pos FROM {_GOOD} UNION ALL SELECT tid, pos FROM {_ALL} WHERE e % 11 <> 0 AND e % 13 <> 0 AND e % 17 = 0 AND tid < 4) GROUP BY tid
UNION ALL SELECT 'offset', part, max(pos), NULL, topic FROM {_ALL} GROUP BY topic, part
UNION ALL SELECT 'history', count(*), count(DISTINCT user_id), NULL, NULL FROM (SELECT *, lag(event_type || op) OVER (PARTITION BY user_id ORDER BY ts_ms, part, pos) AS before FROM {_GOOD} WHERE tid = 0) WHERE op <> 'd' AND (before IS NULL OR before <> event_type || op)"""


def bus_catalog(t):
    return t.spark.range(4).select(F.col("id").alias("catalog_id"), F.lit("s").alias("schema_name"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_name"), F.array(F.lit("id")).alias("pk"))


@query("stream_commit", COMMITTED)
def _(t):
    """Raw messages to mirrors, ledger, dead letters, stats, positions, offsets and one table's history, in two batches."""
    p = Pipeline(t.spark, scratch(t, "lake"), bus_catalog(t), limit=1 << 40, history={0: ["kind"]})
    finish(p.start(log_stream(t, t.bus_log, 2), scratch(t, "checkpoint")))
    none = F.lit(None)
    row = lambda df, side, a, b, c=none, x=none: df.select(F.lit(side).alias("side"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), x.cast("string").alias("s"))
    unknown = F.coalesce("catalog_id", F.lit(-1)).alias("id")
    out = [row(p.mirror(i, ["id"]).read(), "mirror", F.lit(i), F.col("id"), F.col("c"), F.concat("kind", F.lit("/"), F.coalesce("extra", F.lit("-")))) for i in range(4)]
    out.append(row(p.ledger().read().groupBy("catalog_id").count(), "ledger", F.col("catalog_id"), F.col("count")))
    out.append(row(p.table("dlq", DLQ).groupBy(unknown).count(), "dlq", F.col("id"), F.col("count")))
    out.append(row(p.table("stats", STATS).groupBy(unknown).agg(F.sum("seen").alias("seen"), F.sum("parse_skipped").alias("lost")), "stats", F.col("id"), F.col("seen"), F.col("lost")))
    out.append(row(p.table("positions", "catalog_id long, pos long").groupBy("catalog_id").agg(F.max("pos").alias("pos")), "position", F.col("catalog_id"), F.col("pos")))
    out.append(row(p.table("offsets", "topic string, part int, pos long").groupBy("topic", "part").agg(F.max("pos").alias("pos")), "offset", F.col("part"), F.col("pos"), x=F.col("topic")))
    versions = p.history_table(0, ["id"]).read()
    out.append(row(versions.agg(F.count("*").alias("n"), F.countDistinct("id").alias("k")), "history", F.col("n"), F.col("k")))
    return reduce(lambda x, y: x.unionByName(y), out)


@query("stream_release", f"SELECT tid, user_id AS id, c, event_type AS kind FROM {_GOOD} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) = 1 AND op <> 'd'")
def _(t):
    """A table fails in the first half of a log and is held; released in the second, its mirror is that of a run without the failure."""
    # without the changes that lack a key, told by what they say: a position doesn't tell a copy from a first message
    log = t.bus_log.where(~F.coalesce(F.col("value").startswith("{") & ~F.col("value").contains('"id":'), F.lit(False)))
    middle = t.changes.agg(F.max("pos")).first()[0] // 2
    # copies of messages come with the second half while the log has 20,000,000 positions at most, then in either
    first, second = log.where(F.col("pos") <= middle), log.where(F.col("pos") > middle)
    p = Pipeline(t.spark, scratch(t, "lake"), bus_catalog(t), limit=5, rules={"other_table": (F.col("catalog_id") != 2, "23514")})
    p.run(first, 0)
    p.rules = {}
    p.release([2])
    p.run(second, 1)
    return reduce(lambda x, y: x.unionByName(y), [p.mirror(i, ["id"]).read().select(F.lit(i).cast("long").alias("tid"), "id", F.col("c").cast("long").alias("c"), "kind") for i in range(4)])


@query("stream_retry", MIRROR)
def _(t):
    """A batch that fails twice and is then applied, and once more, which changes nothing."""
    table = LakeTable(t.spark, scratch(t, "lake"), KEY, SCHEMA, buckets=4)
    table.merge(t.mirror0.select(*KEY, *DATA, F.lit("c").alias("op"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos")), DATA, 0)
    left = [2]

    def work():
        if left[0]:
            left[0] -= 1
            raise OSError("lost")
        table.merge(t.changes, DATA, 1)

    jobs.with_retries(work, pause_ms=1)
    table.merge(t.changes, DATA, 1)
    return table.read()


@query("stream_dedup", "SELECT catalog_id, CASE WHEN pos % 4 = 1 THEN 'ev:' || (pos - 1) ELSE event_id END AS event_id, pos FROM changes")
def _(t):
    """Every fourth change shares the id of the one before it; what is sent again is gone."""
    shared = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("ev:"), (F.col("pos") - 1).cast("string"))).otherwise(F.col("event_id"))
    twice = t.changes.unionByName(t.changes.where("pos % 3 = 0").withColumn("topic", F.lit("again"))).withColumn("event_id", shared).withColumn("at", F.timestamp_millis("ts_ms"))
    return memory(t, jobs.stream_dedup(log_stream(t, twice), "at", "60 days"), "append").select("catalog_id", "event_id", "pos")


@query("stream_events_tumbling", "SELECT ts_ms // 3600000 * 3600000 AS start_ms, catalog_id, count(*) AS events FROM changes GROUP BY 1, 2")
def _(t):
    stream = log_stream(t, t.changes.withColumn("at", F.timestamp_millis("ts_ms")))
    tail = "9999-01-01 00:00:00"  # a far event lets the watermark pass every window
    end = t.changes.limit(1).withColumn("at", F.to_timestamp(F.lit(tail))).withColumn("catalog_id", F.lit(-1).cast("long"))
    path = scratch(t, "windows")
    rows = t.changes.withColumn("at", F.timestamp_millis("ts_ms"))
    rows.repartition(2).write.parquet(path)
    end.select(*rows.columns).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    out = memory(t, jobs.stream_counts(stream, "at", "40 days"), "append")
    return out.where("catalog_id >= 0").select(F.unix_millis("start").alias("start_ms"), "catalog_id", "events")


derive("markers", "SELECT e AS pos, u AS user_id, t AS payload, CAST(e - e % 10 AS BIGINT) AS tx, CASE e % 10 WHEN 0 THEN 'begin' WHEN 9 THEN CASE WHEN (e - e % 10) % 70 = 0 THEN 'data' ELSE 'commit' END ELSE 'data' END AS kind, ms AS ts_ms FROM ev")
TX = "SELECT tx, count(*) FILTER (kind = 'data') AS events, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM markers GROUP BY 1 HAVING bool_or(kind = 'commit')"


def assembled(t, status: str):
    """Transactions of one status from a log in three parts, most of them cut in two by the parts' ends; two far records
    let the watermark pass what stays open."""
    path, kept = scratch(t, "markers"), ["tx", "kind", "pos", "ts_ms", "payload"]
    end = t.markers.agg(F.max("pos")).first()[0] + 1
    cuts = [0, end // 3 - 5, 2 * end // 3 - 5, end]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        t.markers.where(F.col("pos").between(lo, hi - 1)).select(*kept).coalesce(1).write.mode("append").parquet(path)
    for n in (1, 2):
        far = t.spark.range(1).select(F.lit(-n).cast("long").alias("tx"), F.lit("begin").alias("kind"), (F.lit(end) + n).cast("long").alias("pos"), F.lit(4_000_000_000_000 + n).alias("ts_ms"), F.lit(None).cast("string").alias("payload"))
        far.write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(far.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with rocksdb(t.spark):
        rows = memory(t, assemble(stream, "40 days", 3_600_000), "append")
    return rows.where((F.col("status") == status) & (F.col("tx") >= 0)).groupBy("tx").agg(F.count_if(F.col("nth") > 0).alias("events"), F.max("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


@query("stream_tx_assemble", TX)
def _(t):
    return assembled(t, "complete")


@query("stream_tx_unfinished", TX.replace("HAVING", "HAVING NOT"))
def _(t):
    return assembled(t, "unfinished")


@query("tx_assemble", TX)
def _(t):
    return jobs.transactions(t.markers)


@query("stream_scd2", "SELECT * FROM hist")
def _(t):
    from .applying import HDATA

    table = HistoryTable(t.spark, scratch(t, "history"), KEY, HDATA, "user_id long, event_type string, band long", buckets=4)
    changes = log_stream(t, t.changes, 12).withColumn("band", F.col("cents") % 3)
    finish(table.start(changes, scratch(t, "checkpoint")))
    return table.read()


@query("stream_quarantine", "SELECT user_id, event_type, cents, 'mirror' AS side FROM (SELECT * FROM changes WHERE catalog_id <> 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part DESC, pos DESC) = 1) WHERE op <> 'd' UNION ALL SELECT user_id, event_type, cents, 'held' FROM changes WHERE catalog_id = 2")
def _(t):
    table, held = LakeTable(t.spark, scratch(t, "lake"), KEY, SCHEMA, buckets=4), scratch(t, "held")
    finish(jobs.stream_quarantine(log_stream(t, t.changes), table, DATA, lambda b: b.where("catalog_id = 2"), held, scratch(t, "checkpoint")))
    kept = t.spark.read.parquet(held).select(*KEY, *DATA, F.lit("held").alias("side"))
    return table.read().withColumn("side", F.lit("mirror")).unionByName(kept)


