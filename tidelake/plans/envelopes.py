"""Envelopes, routing and coercion."""

from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions import envelope as v
from ..functions import types as ty
from ..operators import routing as r
from .registry import derive, query

derive("names", "SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '9' || c_name WHEN 2 THEN '__' || c_mktsegment WHEN 3 THEN '#' WHEN 4 THEN 'A b-C.' || CAST(c_custkey AS STRING) ELSE c_mktsegment || '_gho' END AS raw, c_mktsegment AS scope FROM customer")
derive("tokens", "SELECT e, CASE e % 16 WHEN 0 THEN '1' WHEN 1 THEN 'b''0''' WHEN 2 THEN ' TRUE ' WHEN 3 THEN 'no' WHEN 4 THEN 'maybe' WHEN 5 THEN '0x01' WHEN 6 THEN 'X''00''' WHEN 7 THEN '' WHEN 8 THEN 'Yes' WHEN 9 THEN '0x0102' WHEN 10 THEN 'b''1''' WHEN 11 THEN 'F' WHEN 12 THEN NULL WHEN 13 THEN t ELSE CAST(u AS STRING) END AS tok FROM ev")
derive("numbers", "SELECT e, CASE e % 7 WHEN 0 THEN '-1 (' || CAST(4294967295 - e AS STRING) || ')' WHEN 1 THEN CAST(cents AS STRING) WHEN 2 THEN '  +12.5e3 rest' WHEN 3 THEN t WHEN 4 THEN CAST(e AS STRING) || ' units (x)' WHEN 5 THEN NULL ELSE '-7' END AS x FROM ev")
derive("dates", "SELECT e, CASE e % 8 WHEN 0 THEN '2024:0' || CAST(e % 9 + 1 AS STRING) || ':15' WHEN 1 THEN '0000-00-00' WHEN 2 THEN '2024-00-10' WHEN 3 THEN '2023-1' || CAST(e % 3 AS STRING) || '-05 10:11:12' WHEN 4 THEN t WHEN 5 THEN NULL WHEN 6 THEN '2024-02-3' || CAST(e % 2 AS STRING) ELSE ' 1999-12-31T23:59:59.5 ' END AS x FROM ev")
derive("clocks", "SELECT e, CASE e % 6 WHEN 0 THEN '10:1' || CAST(e % 10 AS STRING) || ':12' WHEN 1 THEN '1:2:3.5' WHEN 2 THEN '10:11:12:345' WHEN 3 THEN t WHEN 4 THEN '10:11' ELSE '10:11:12,5' END AS x FROM ev")
derive("messages", "SELECT topic, part, pos, CASE WHEN pos % 11 = 0 THEN NULL WHEN pos % 13 = 0 THEN 'garbage' ELSE (CASE WHEN pos % 5 = 0 THEN 'xyzzy' ELSE '' END) || '{\"op\":\"' || (CASE WHEN pos % 3 = 0 THEN (CASE op WHEN 'c' THEN 'INSERT' WHEN 'u' THEN 'UPDATE' ELSE 'DELETE' END) ELSE op END) || '\",\"source_schema\":\"s\",\"source_table\":\"t' || CAST(catalog_id AS STRING) || '\",\"source\":{\"gtid\":\"g' || CAST(pos AS STRING) || '\",\"ts_ms\":' || CAST(ts_ms AS STRING) || '},\"before\":{\"id\":' || CAST(user_id AS STRING) || '},\"after\":{\"id\":' || CAST(user_id AS STRING) || ',\"c\":' || CAST(cents AS STRING) || '}}' END AS value FROM changes")


#: Bus values of all engines and shapes by pos % 12: 0 null, 1 no JSON, 2 MariaDB behind other bytes, 3 names in the source
#: and a file position, 4 SQL Server, 5 MongoDB with names in the source, 6 and 7 wrapped, 7 with names in its id only,
#: 8 without names, 9 an update with a before image and a key as text, 10 a number among the names' places, 11 a delete.
_ROW = "'{\"id\":' || CAST(user_id AS STRING) || ',\"c\":' || CAST(cents AS STRING) || '}'"
_OP = "'{\"op\":\"' || CASE WHEN pos % 2 = 0 THEN 'INSERT' ELSE 'c' END || '\",'"
_TS = "'\"ts_ms\":' || CAST(ts_ms AS STRING)"
_WRAP = "'{\"specversion\":\"1.0\",\"id\":\"mssql:db:9|dbo.T-' || CAST(catalog_id AS STRING) || '|c|id=1\",\"data\":'"
derive("wire", f"""SELECT topic, part, pos, ts_ms + 1 AS time, CASE pos % 12
  WHEN 0 THEN NULL WHEN 1 THEN 'garbage {{'
  WHEN 2 THEN 'xyzzy' || {_OP} || '\"catalog_id\":' || CAST(catalog_id AS STRING) || ',\"source_schema\":\"s\",\"source_table\":\"t\",\"source\":{{\"gtid\":\"g\",' || {_TS} || '}},\"after\":' || {_ROW} || '}}'
  WHEN 3 THEN {_OP} || '\"source\":{{\"db\":\"S\",\"table\":\"T-1\",\"file\":\"f.1\",\"pos\":' || CAST(pos AS STRING) || '}},' || {_TS} || ',\"after\":' || {_ROW} || '}}'
  WHEN 4 THEN {_OP} || '\"db_engine\":\"mssql\",\"source_database\":\"Db\",\"source_schema\":\"dbo\",\"source_table\":\"Cust-1\",\"source\":{{\"lsn\":\"0a\",\"seqval\":\"7\"}},\"after\":' || {_ROW} || '}}'
  WHEN 5 THEN {_OP} || '\"source\":{{\"db_engine\":\"mongodb\",\"database\":\"My-Db\",\"collection\":\"C.1\",\"resume_token\":{{\"_data\":\"k\"}}}},\"after\":{{\"mongo_id\":{{\"$oid\":\"o1\"}},\"id\":' || CAST(user_id AS STRING) || '}}}}'
  WHEN 6 THEN {_WRAP} || {_OP} || '\"schema\":\"s\",\"table\":\"t\",\"gtid\":\"g\",' || {_TS} || ',\"after\":' || {_ROW} || '}}}}'
  WHEN 7 THEN {_WRAP} || {_OP} || {_TS} || ',\"after\":' || {_ROW} || '}}}}'
  WHEN 8 THEN {_OP} || {_TS} || ',\"after\":' || {_ROW} || '}}'
  WHEN 9 THEN '{{\"op\":\"u\",\"source_schema\":\"s\",\"source_table\":\"t\",\"gtid\":\"g\",' || {_TS} || ',\"before\":{{\"c\":1,\"z\":\"old\",\"id\":5}},\"after\":{{\"id\":\"00' || CAST(user_id AS STRING) || '\",\"c\":null}}}}'
  WHEN 10 THEN {_OP} || '\"source_schema\":7,\"source_table\":\"\",\"source\":{{\"table\":\"t\"}},' || {_TS} || '}}'
  ELSE '{{\"op\":\"DELETE\",\"source_schema\":\"s\",\"source_table\":\"t\",\"gtid\":\"g\",' || {_TS} || ',\"before\":' || {_ROW} || ',\"after\":null}}' END AS value,
  op, catalog_id, user_id, cents, ts_ms FROM changes""")
PARSED = """SELECT topic, part, pos, CASE pos % 12 WHEN 9 THEN 'u' WHEN 11 THEN 'd' ELSE 'c' END AS op, CASE pos % 12 WHEN 4 THEN 'mssql' WHEN 5 THEN 'mongodb' ELSE 'mariadb' END AS engine,
  CASE WHEN pos % 12 = 2 THEN catalog_id ELSE 0 END AS catalog_id,
  CASE pos % 12 WHEN 3 THEN 'S' WHEN 4 THEN 'db_dbo' WHEN 5 THEN 'my_db' WHEN 7 THEN 'db_dbo' WHEN 10 THEN '7' ELSE 's' END AS schema_name,
  CASE pos % 12 WHEN 3 THEN 'T-1' WHEN 4 THEN 'cust_1' WHEN 5 THEN 'c_1' WHEN 7 THEN 't_' || catalog_id ELSE 't' END AS table_name,
  CASE pos % 12 WHEN 3 THEN NULL WHEN 4 THEN '0a' WHEN 5 THEN '{"_data":"k"}' WHEN 7 THEN NULL WHEN 10 THEN NULL ELSE 'g' END AS gtid,
  CASE pos % 12 WHEN 2 THEN 'g|s.t|c|id=' || user_id WHEN 3 THEN 'f.1:' || pos || '|S.T-1|c|id=' || user_id WHEN 4 THEN 'mssql:Db:0a:7|dbo.Cust-1|c|id=' || user_id
    WHEN 5 THEN 'mongo:My-Db:{"_data":"k"}|.|c|id=' || user_id WHEN 9 THEN 'g|s.t|u|id=' || user_id WHEN 11 THEN 'g|s.t|d|id=' || user_id
    WHEN 10 THEN ':0|7.|c|' || '{"op":"' || CASE WHEN pos % 2 = 0 THEN 'INSERT' ELSE 'c' END || '","source":{"table":"t"},"source_schema":7,"source_table":"","ts_ms":' || ts_ms || '}'
    ELSE 'mssql:db:9|dbo.T-' || catalog_id || '|c|id=1' END AS event_id,
  CASE WHEN pos % 12 IN (4, 5) THEN ts_ms + 1 ELSE ts_ms END AS ts_ms,
  CASE pos % 12 WHEN 5 THEN '{"id":' || user_id || ',"mongo_id":"o1"}' WHEN 9 THEN '{"c":null,"id":' || user_id || ',"z":"old"}' WHEN 10 THEN '{}' ELSE '{"c":' || cents || ',"id":' || user_id || '}' END AS row
  FROM wire WHERE pos % 12 NOT IN (0, 1, 8)"""


@query("env_parse", PARSED)
def _(t):
    return v.parse(t.wire.select("topic", "part", "pos", "time", "value"), keys=("id",))


@query("env_skip_counts", "SELECT topic, part, count(*) AS seen, count(*) FILTER (pos % 12 = 0) AS tombstones, count(*) FILTER (pos % 12 = 1) AS no_envelope, count(*) FILTER (pos % 12 = 8) AS no_table, count(*) FILTER (pos % 12 IN (0, 1, 8)) AS parse_skipped FROM wire GROUP BY 1, 2")
def _(t):
    return v.skip_counts(v.parse(t.wire.select("topic", "part", "pos", "time", "value"), keys=("id",), with_skipped=True))


@query("env_probe", "SELECT pos, pos % 11 <> 0 AND pos % 13 <> 0 AS decoded FROM changes")
def _(t):
    return t.messages.select("pos", v.probe(F.col("value")).isNotNull().alias("decoded"))


@query("env_op_normalize", "SELECT e, CASE e % 5 WHEN 0 THEN 'u' WHEN 1 THEN 'c' WHEN 2 THEN 'd' WHEN 3 THEN 'u' ELSE 'hb' END AS op FROM ev")
def _(t):
    raw = F.element_at(F.array(F.lit(None), F.lit("INSERT"), F.lit("DELETE"), F.lit("UPDATE"), F.lit("hb")), (F.col("e") % 5 + 1).cast("int"))
    return t.ev.select("e", v.op_normalize(raw).alias("op"))


@query("env_row_image", "SELECT pos, CASE WHEN op = 'd' THEN CASE WHEN pos % 2 = 0 THEN 'b' || pos ELSE '{}' END ELSE 'a' || pos END AS row FROM changes")
def _(t):
    before = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("b"), F.col("pos").cast("string")))
    return t.changes.select("pos", v.row_image(F.col("op"), before, F.concat(F.lit("a"), F.col("pos").cast("string"))).alias("row"))


def _maps(t):
    s = lambda x: F.col(x).cast("string")
    row = F.map_filter(F.create_map(F.lit("id"), s("user_id"), F.lit("c"), F.when(F.col("pos") % 3 == 0, s("cents"))), lambda k, x: x.isNotNull() | (F.col("pos") % 2 == 0))
    return row, F.create_map(F.lit("id"), F.lit("0"), F.lit("c"), F.lit("old"))


FILL = "SELECT pos, CAST(user_id AS STRING) AS id, CASE WHEN pos % 3 = 0 THEN CAST(cents AS STRING) WHEN op <> 'u' THEN NULL WHEN pos % 2 = 0 THEN {null} ELSE 'old' END AS c FROM changes"


@query("env_fill_before", FILL.replace("{null}", "NULL"))
def _(t):
    row, before = _maps(t)
    return t.changes.select("pos", v.fill_before(F.col("op"), row, before).alias("m")).select("pos", F.col("m")["id"].alias("id"), F.try_element_at("m", F.lit("c")).alias("c"))


@query("env_fill_before_nulls", FILL.replace("{null}", "'old'"))
def _(t):
    row, before = _maps(t)
    return t.changes.select("pos", v.fill_before(F.col("op"), row, before, True).alias("m")).select("pos", F.col("m")["id"].alias("id"), F.try_element_at("m", F.lit("c")).alias("c"))


@query("env_pk_normalize", "SELECT e, CASE WHEN e % 3 = 0 THEN CAST(u AS STRING) WHEN e % 3 = 1 THEN 'k' || u ELSE '1-2' END AS pk FROM ev")
def _(t):
    raw = F.when(F.col("e") % 3 == 0, F.concat(F.lit("000"), F.col("u").cast("string"))).when(F.col("e") % 3 == 1, F.concat(F.lit("k"), F.col("u").cast("string"))).otherwise("1-2")
    return t.ev.select("e", v.pk_normalize(raw).alias("pk"))


@query("env_object_id", "SELECT e, CASE e % 4 WHEN 0 THEN 'a' || u WHEN 1 THEN 'b' || u WHEN 2 THEN 'c' || u ELSE CAST(u AS STRING) END AS id FROM ev")
def _(t):
    u = F.col("u").cast("string")
    raw = F.when(F.col("e") % 4 == 0, F.concat(F.lit('{"$oid":"a'), u, F.lit('"}'))).when(F.col("e") % 4 == 1, F.concat(F.lit('{"oid":"b'), u, F.lit('"}'))).when(F.col("e") % 4 == 2, F.concat(F.lit('"c'), u, F.lit('"'))).otherwise(u)
    return t.ev.select("e", v.object_id(raw).alias("id"))


EVENT_ID = "SELECT pos, CASE pos % 3 WHEN 0 THEN 'f.1:' || pos WHEN 1 THEN 'mssql:db:' || pos || ':7' ELSE 'mongo:db:' || pos END || '|s.t' || catalog_id || '|' || op || '|' || CASE WHEN pos % 4 = 0 THEN 'whole' ELSE 'id=' || user_id || '|z=\"q\"' END AS id FROM changes"


def event_ids(t):
    pos = F.col("pos")
    engine = F.element_at(F.array(F.lit("mariadb"), F.lit("mssql"), F.lit("mongodb")), (pos % 3 + 1).cast("int"))
    gtid = F.when(pos % 3 != 0, pos.cast("string"))
    keys = [("id", F.when(pos % 4 != 0, F.col("user_id").cast("string"))), ("z", F.when(pos % 4 != 0, F.lit('"q"')))]
    return t.changes.select("pos", v.event_id(engine, F.lit("db"), gtid, F.lit("f.1"), pos, F.lit("7"), F.lit("s"), F.concat(F.lit("t"), F.col("catalog_id").cast("string")), F.col("op"), keys, F.lit("whole")).alias("id"))


@query("env_event_id", EVENT_ID)
def _(t):
    return event_ids(t)


@query("env_key_from_event_id", "SELECT pos, 's' AS schema_name, 't' || catalog_id AS table_name FROM changes")
def _(t):
    return event_ids(t).select("pos", v.key_from_event_id(F.col("id")).alias("k")).select("pos", "k.*")


@query("env_matches_table", "SELECT pos, catalog_id IN (1, 3) AS hit FROM changes")
def _(t):
    return t.changes.select("pos", v.matches(F.lit("S"), F.concat(F.lit("t"), F.col("catalog_id").cast("string")), [("s", "T1"), ("s", "t3")]).alias("hit"))


@query("env_build", "SELECT pos, '{\"op\":\"' || op || '\",\"db_engine\":\"mariadb\",\"source_schema\":\"s\",\"source_table\":\"t\",\"after\":{\"id\":' || user_id || '},\"source\":{\"ts_ms\":' || ts_ms || '}}' AS value FROM changes")
def _(t):
    return t.changes.select("pos", v.build(F.col("op"), F.lit("mariadb"), F.lit("s"), F.lit("t"), F.lit(None), F.struct(F.col("user_id").alias("id")), F.struct("ts_ms")).alias("value"))


@query("env_cloudevents", "SELECT pos, '{\"specversion\":\"1.0\",\"id\":\"' || event_id || '\",\"source\":\"src\",\"type\":\"row.' || op || '\",\"time\":\"t\",\"subject\":\"s.t\",\"data\":{\"op\":\"' || op || '\"}}' AS value, op FROM changes")
def _(t):
    data = F.concat(F.lit('{"op":"'), F.col("op"), F.lit('"}'))
    wrapped = t.changes.select("pos", v.cloud_event(F.col("event_id"), F.concat(F.lit("row."), F.col("op")), F.lit("src"), F.lit("s.t"), F.lit("t"), data).alias("value"))
    return wrapped.select("pos", "value", v.get(v.unwrap_cloud_event(F.col("value")), "$.op").alias("op"))


#: A quoted literal in fifty is as long as a large cell.
LONG = "CASE WHEN e % 50 = 3 THEN repeat('it''s } ', 20000) ELSE 'it''s ' END"


@query("env_sql_literal", f"SELECT e, CASE e % 9 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'bytes' WHEN 3 THEN 'string' WHEN 4 THEN 'int' WHEN 5 THEN 'float' WHEN 6 THEN 'string' ELSE 'raw' END AS kind, md5(CASE e % 9 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN '0x1F' WHEN 3 THEN {LONG} || t WHEN 4 THEN CAST(u AS STRING) WHEN 5 THEN '-1.5' WHEN 6 THEN '' WHEN 7 THEN chr(39) ELSE t END) AS text_md5 FROM ev")
def _(t):
    e, u = F.col("e") % 9, F.col("u").cast("string")
    long = F.when(F.col("e") % 50 == 3, F.repeat(F.lit("it''s } "), 20000)).otherwise("it''s ")
    raw = F.when(e == 0, "null").when(e == 1, "b'1'").when(e == 2, "0x1F").when(e == 3, F.concat(F.lit("'"), long, F.col("t"), F.lit("'"))).when(e == 4, u).when(e == 5, "-1.5").when(e == 6, "''").when(e == 7, "'").otherwise(F.col("t"))
    return t.ev.select("e", v.sql_literal(raw).alias("x")).select("e", "x.kind", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


@query("env_tx_id", "SELECT e, e AS id FROM ev")
def _(t):
    return t.ev.select("e", v.tx_id(F.concat(F.lit("0x"), F.lower(F.hex("e")))).alias("id"))


@query("env_mongo_tx_id", "SELECT e, CASE e % 3 WHEN 0 THEN u WHEN 1 THEN 255 ELSE e END AS id, e % 3 = 0 AS transactional FROM ev")
def _(t):
    u, e = F.col("u").cast("string"), F.col("e").cast("string")
    doc = F.when(F.col("e") % 3 == 0, F.concat(F.lit('{"txnNumber":'), u, F.lit("}"))).when(F.col("e") % 3 == 1, F.lit('{"lsid":{"id":"ff"}}')).otherwise(F.concat(F.lit('{"clusterTime":{"t":'), e, F.lit("}}")))
    return t.ev.select("e", v.mongo_tx_id(F.try_parse_json(doc)).alias("x")).select("e", "x.*")


@query("env_ddl_event", "SELECT e, e % 5 IN (0, 1, 2) AS ddl FROM ev")
def _(t):
    s = F.element_at(F.array(*[F.lit(x) for x in ("ALTER TABLE x", " create table y", "Drop z", "alt", "insert into t")]), (F.col("e") % 5 + 1).cast("int"))
    return t.ev.select("e", v.is_ddl(s).alias("ddl"))


@query("env_heartbeat", "SELECT conn_id, count(*) AS beats, max(logged_ms) AS last_ms FROM logs WHERE level = 'info' GROUP BY 1")
def _(t):
    return t.logs.where("level = 'info'").groupBy("conn_id").agg(F.count("*").alias("beats"), F.max("logged_ms").alias("last_ms"))


SANITIZED = "CASE WHEN s = '' THEN 'x' WHEN regexp_matches(s, '^[0-9]') THEN 't_' || s ELSE s END"


@query("ident_sanitize", f"SELECT k, left({SANITIZED}, 20) AS ident FROM (SELECT k, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_]', '_', 'g'), '^_+', '') AS s FROM names)")
def _(t):
    return t.names.select("k", v.sanitize(F.col("raw"), 20).alias("ident"))


@query("ident_disambiguate", "SELECT scope, count(*) AS names, count(DISTINCT raw) AS idents FROM names GROUP BY 1")
def _(t):
    return v.disambiguate(t.names.select("scope", "raw").distinct(), "scope", "raw").join(t.names.groupBy("scope").agg(F.count("*").alias("names")), "scope").groupBy("scope", "names").agg(F.countDistinct("ident").alias("idents"))


@query("lake_name_map", "SELECT catalog_id, CASE db_engine WHEN 'mssql' THEN source_database || '_' || source_schema WHEN 'mongodb' THEN source_database ELSE source_schema END AS lake_schema, source_table AS lake_table FROM catalog")
def _(t):
    return t.catalog.select("catalog_id", v.lake_name(F.col("db_engine"), F.col("source_database"), F.col("source_schema"), F.col("source_table")).alias("x")).select("catalog_id", "x.*")


@query("message_key", "SELECT pos, 's.t' || catalog_id || '|id=''' || event_type || '''' AS k1, 's.t|id=' || user_id AS k2, 's.t' AS k3 FROM changes")
def _(t):
    tab = F.concat(F.lit("t"), F.col("catalog_id").cast("string"))
    return t.changes.select("pos", v.message_key(F.lit("s"), tab, "id", F.col("event_type")).alias("k1"), v.message_key(F.lit("s"), F.lit("t"), "id", F.col("user_id"), "long").alias("k2"), v.message_key(F.lit("s"), F.lit("t"), "id", F.lit(None).cast("string")).alias("k3"))


@query("split_pk_columns", "SELECT catalog_id, CASE WHEN pk_columns = 'id' THEN 'id' ELSE 'tenant+id' END AS cols FROM catalog")
def _(t):
    return t.catalog.select("catalog_id", F.array_join(v.split_columns(F.concat("pk_columns", F.lit(" , ,"))), "+").alias("cols"))


# ---------------------------------------------------------------- routing


@query("flt_op_exclude", "SELECT pos, op FROM changes WHERE op NOT IN ('d', 't')")
def _(t):
    return r.exclude_ops(t.changes, ["d", "t"]).select("pos", "op")


@query("route_content", "SELECT pos, CASE WHEN op = 'd' THEN topic || '.deletes' WHEN event_type = 'purchase' THEN 'sales' WHEN cents > 5000 THEN topic || '.large' ELSE topic END AS target FROM changes")
def _(t):
    rules = [{"when": {"op": "d"}, "topic_suffix": ".deletes"}, {"when": {"path": "after.event_type", "equals": "purchase"}, "topic": "sales"}, {"when": {"path": "after.large"}, "topic_suffix": ".large"}, {"when": {}, "topic": "never"}]
    fields = {"op": F.col("op"), "after.event_type": F.col("event_type"), "after.large": F.when(F.col("cents") > 5000, F.col("cents"))}
    return t.changes.select("pos", r.route(F.col("topic"), rules, fields).alias("target"))


@query("flt_table_regex", "SELECT catalog_id FROM catalog WHERE (source_schema = 'building' OR regexp_full_match(source_table, 't_1[0-9]+')) AND NOT regexp_full_match(source_table, 't_.*7')")
def _(t):
    return t.catalog.where(r.table_wanted(F.col("source_schema"), F.col("source_table"), ["BUILDING\\..*", "t_1[0-9]+", "(bad"], [".*\\.t_.*7", "t_.*7"])).select("catalog_id")


@query("flt_online_ddl", "SELECT k, raw FROM names WHERE NOT (raw LIKE '%\\_gho' ESCAPE '\\')")
def _(t):
    return t.names.where(~r.is_online_ddl(F.col("raw"))).select("k", "raw")


@query("col_policy_project", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return r.project_policy(t.customer, include=["c_custkey", "c_name", "c_acctbal"], exclude=["c_acctbal"])


@query("col_policy_mask", "SELECT e, CASE WHEN e % 3 = 0 THEN '' ELSE sha256(t) END AS masked, t AS kept FROM ev")
def _(t):
    x = F.when(F.col("e") % 3 == 0, "").otherwise(F.col("t"))
    return t.ev.select("e", r.mask(x, "hash").alias("masked"), r.mask(F.col("t"), "partial").alias("kept"))


@query("flt_wanted_split", "SELECT stat_id, CASE WHEN catalog_id % 2 = 1 THEN 'unwanted' WHEN catalog_id % 6 = 0 THEN 'quarantined' ELSE 'wanted' END AS fate FROM stats")
def _(t):
    return r.split_wanted(t.stats, t.catalog.where("catalog_id % 2 = 0"), t.catalog.where("catalog_id % 6 = 0")).select("stat_id", "fate")


GATE = "active AND cdc_enabled AND has_pk AND status NOT IN ('skipped', 'disabled') AND catalog_id NOT IN (SELECT catalog_id FROM signals WHERE action = 'execute_blocking' AND status IN ('pending', 'running', 'paused'))"


@query("flt_capture_eligible", f"SELECT catalog_id FROM catalog WHERE {GATE} AND (NOT needs_full_load OR (db_engine <> 'mssql' AND capture_during_full_load))")
def _(t):
    return r.eligible(t.catalog, t.signals, "capture").select("catalog_id")


@query("flt_apply_eligible", f"SELECT catalog_id FROM catalog WHERE {GATE} AND NOT needs_full_load")
def _(t):
    return r.eligible(t.catalog, t.signals, "apply").select("catalog_id")


@query("flt_full_load_targets", "SELECT catalog_id FROM catalog WHERE active AND snapshot_mode <> 'never' AND needs_full_load AND (status <> 'full_load_in_progress' OR catalog_id IN (SELECT catalog_id FROM checkpoints WHERE phase = 'copy'))")
def _(t):
    return r.load_targets(t.catalog, t.checkpoints).select("catalog_id")


@query("skip_reasons", "SELECT conn_id, db_engine, count(*) AS active_total, count(*) FILTER (needs_full_load) AS needs_full_load, count(*) FILTER (NOT cdc_enabled) AS cdc_disabled, count(*) FILTER (NOT has_pk) AS no_pk, count(*) FILTER (status IN ('skipped', 'disabled')) AS skipped_status, count(*) FILTER (cdc_enabled AND NOT needs_full_load AND has_pk AND status NOT IN ('skipped', 'disabled')) AS apply_ready FROM catalog WHERE active GROUP BY 1, 2")
def _(t):
    return r.skip_reasons(t.catalog)


@query("shard_mod", "SELECT catalog_id, ((catalog_id - 700) % 24 + 24) % 24 AS worker FROM catalog")
def _(t):
    return t.catalog.select("catalog_id", r.shard(F.col("catalog_id") - 700, 24).alias("worker"))


@query("topic_bucket", "SELECT catalog_id, 'lake.b' || lpad(CAST(('0x' || left(sha256(source_schema || '.' || source_table), 8))::BIGINT % 64 AS STRING), 4, '0') AS topic FROM catalog")
def _(t):
    return t.catalog.select("catalog_id", r.topic_bucket(F.col("source_schema"), F.col("source_table"), "lake").alias("topic"))


@query("resolve_casefold", "SELECT e, CASE e % 4 WHEN 0 THEN u WHEN 1 THEN u END AS resolved_id, CASE e % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'casefold' WHEN 2 THEN 'schema_mismatch' ELSE 'none' END AS kind FROM ev JOIN catalog c ON c.catalog_id = u")
def _(t):
    rows = t.sql("SELECT e, CASE e % 4 WHEN 0 THEN source_schema WHEN 1 THEN upper(source_schema) ELSE 'other' END AS schema_name, CASE e % 4 WHEN 1 THEN upper(source_table) WHEN 3 THEN 'gone' ELSE source_table END AS table_name FROM ev JOIN catalog c ON c.catalog_id = u")
    return r.resolve_casefold(rows, t.catalog).select("e", "resolved_id", "kind")


@query("resolve_catalog_key", "SELECT s.stat_id, CASE WHEN c.conn_id = s.conn_id THEN c.source_schema || '.' || c.source_table END AS lake_key, coalesce(c.conn_id = s.conn_id, false) AS resolved FROM stats s LEFT JOIN catalog c ON c.catalog_id = s.catalog_id")
def _(t):
    return r.resolve_key(t.stats, t.catalog).select("stat_id", "lake_key", "resolved")


@query("flt_ddl_rotation", "SELECT catalog_id FROM catalog WHERE last_error IS NOT NULL OR catalog_id % 20 = 7")
def _(t):
    return r.ddl_rotation(t.catalog, 47).select("catalog_id")


# ---------------------------------------------------------------- coercion


@query("fn_bool_token", "SELECT e, CASE WHEN lower(trim(tok)) IN ('1', 'true', 'yes', 't', '0x01', 'b''1''') THEN true WHEN lower(trim(tok)) IN ('0', 'no', 'f', 'false', 'x''00''', 'b''0''') THEN false END AS x FROM tokens")
def _(t):
    return t.tokens.select("e", c.bool_token(F.col("tok")).alias("x"))


@query("fn_numeric_sanitize", "SELECT e, CASE e % 7 WHEN 0 THEN CAST(4294967295 - e AS STRING) WHEN 2 THEN '+12.5e3' WHEN 4 THEN CAST(e AS STRING) WHEN 3 THEN CASE WHEN left(x, 1) = 'e' THEN 'e' ELSE x END ELSE x END AS n FROM numbers")
def _(t):
    return t.numbers.select("e", c.numeric_text(F.col("x")).alias("n"))


@query("fn_int32_overflow", "SELECT e, ms * (e % 2) > 2147483647 AS over FROM ev")
def _(t):
    return t.ev.select("e", c.int32_overflow(F.col("ms") * (F.col("e") % 2)).alias("over"))


@query("fn_bytea_decode", "SELECT e, CASE e % 5 WHEN 0 THEN '0aff' WHEN 1 THEN '0102' WHEN 2 THEN lower(hex(t)) WHEN 3 THEN 'abcd' ELSE '00ff' END AS h FROM ev")
def _(t):
    raw = F.element_at(F.array(F.lit("X'0aFF'"), F.lit("\\x01\\x02"), F.col("t"), F.lit("ABcd"), F.lit("_binary '\\x00ff'")), (F.col("e") % 5 + 1).cast("int"))
    return t.ev.select("e", c.bytes_hex(raw).alias("h"))


@query("fn_utf8_sanitize", "SELECT e, t || '?' || u AS x FROM ev")
def _(t):
    raw = F.concat(F.encode("t", "UTF-8"), F.unhex(F.lit("00FF")), F.encode(F.col("u").cast("string"), "UTF-8"))
    return t.ev.select("e", c.utf8_text(raw).alias("x"))


@query("fn_mssql_text", "SELECT e, CASE WHEN e % 2 = 0 THEN t || 'é' ELSE t || 'é!' END AS x FROM ev")
def _(t):
    raw = F.when(F.col("e") % 2 == 0, F.concat(F.encode("t", "UTF-8"), F.unhex(F.lit("E9")))).otherwise(F.concat(F.encode(F.concat("t", F.lit("é!")), "UTF-8"), F.unhex(F.lit("00"))))
    return t.ev.select("e", c.single_byte_text(raw).alias("x"))


@query("fn_date_normalize", "SELECT e, CASE e % 8 WHEN 0 THEN '2024-0' || CAST(e % 9 + 1 AS STRING) || '-15' WHEN 3 THEN '2023-1' || CAST(e % 3 AS STRING) || '-05' WHEN 7 THEN '1999-12-31' END AS d FROM dates")
def _(t):
    return t.dates.select("e", c.date_text(F.col("x")).alias("d"))


@query("fn_ts_normalize", "SELECT e, CASE e % 8 WHEN 0 THEN '2024-0' || CAST(e % 9 + 1 AS STRING) || '-15 00:00:00' WHEN 3 THEN '2023-1' || CAST(e % 3 AS STRING) || '-05 10:11:12' WHEN 4 THEN '2024-03-0' || CAST(e % 9 + 1 AS STRING) || ' 13:05:06.007' WHEN 7 THEN '1999-12-31 23:59:59.5' END AS ts FROM dates")
def _(t):
    named = F.when(F.col("e") % 8 == 4, F.concat(F.lit("Mar "), (F.col("e") % 9 + 1).cast("string"), F.lit(" 2024  1:05:06:007PM"))).otherwise(F.col("x"))
    return t.dates.select("e", c.timestamp_text(named).alias("ts"))


@query("fn_time_normalize", "SELECT e, CASE e % 6 WHEN 2 THEN '10:11:12.345' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE x END AS tm FROM clocks")
def _(t):
    return t.clocks.select("e", c.time_text(F.col("x")).alias("tm"))


@query("fn_epoch", "SELECT e, strftime(make_timestamp((ms // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS s, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.') || lpad(CAST(ms % 1000 AS STRING), 3, '0') AS m FROM ev")
def _(t):
    return t.ev.select("e", c.epoch_seconds_text(F.floor(F.col("ms") / 1000)).alias("s"), c.epoch_millis_text(F.col("ms")).alias("m"))


@query("fn_not_null_default", "SELECT e, CASE WHEN e % 2 = 0 THEN '1970-01-01' ELSE t END AS d, CASE WHEN e % 2 = 0 THEN '__missing__' || left(sha256(CAST(e AS STRING)), 12) ELSE t END AS x FROM ev")
def _(t):
    x = F.when(F.col("e") % 2 == 1, F.col("t"))
    return t.ev.select("e", c.not_null_default(x, "DATE", F.col("e")).alias("d"), c.not_null_default(x, "TEXT", F.col("e")).alias("x"))


@query("fn_copy_cell", "SELECT e, CASE WHEN lower(trim(tok)) IN ('1', 'true', 'yes', 't', '0x01', 'b''1''') THEN 'true' WHEN lower(trim(tok)) IN ('0', 'no', 'f', 'false', 'x''00''', 'b''0''') THEN 'false' END AS cell, tok IS NULL OR tok = '' AS reject FROM tokens")
def _(t):
    return t.tokens.select("e", c.copy_cell(F.col("tok"), "BOOLEAN")[0].alias("cell"), c.copy_cell(F.col("tok"), "TEXT", True)[1].alias("reject"))


@query("fn_json_cell", "SELECT e, strftime(make_timestamp((ms // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS cell FROM ev")
def _(t):
    return t.ev.select("e", c.json_cell(F.floor(F.col("ms") / 1000).cast("string"), "TIMESTAMPTZ").alias("cell"))


@query("fn_type_map_mariadb", "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'BIT(8)' WHEN 2 THEN 'SMALLINT' WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'TIMESTAMPTZ' WHEN 5 THEN 'BYTEA' WHEN 6 THEN 'BOOLEAN' ELSE 'TEXT' END AS type FROM part")
def _(t):
    d = F.element_at(F.array(*[F.lit(x) for x in ("bigint(20) UNSIGNED", "bit(8)", "tinyint(1)", "int(11)", "datetime(6)", "longblob", "bit(1)", "varchar(20)")]), (F.col("p_size") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", ty.mariadb_type(d).alias("type"))


@query("fn_type_map_mssql", "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'NUMERIC(' || p_size || ',2)' WHEN 1 THEN 'VARCHAR(' || p_size || ')' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'UUID' WHEN 4 THEN 'NUMERIC(19,4)' WHEN 5 THEN 'TIMESTAMPTZ' ELSE 'BOOLEAN' END AS type FROM part")
def _(t):
    n = F.element_at(F.array(*[F.lit(x) for x in ("decimal", "nvarchar", "varchar", "uniqueidentifier", "money", "datetime2", "bit")]), (F.col("p_size") % 7 + 1).cast("int"))
    length = F.when(F.col("p_size") % 7 == 2, -1).otherwise(F.col("p_size") * 2)
    return t.part.select("p_partkey", ty.mssql_type(n, length, F.col("p_size"), F.lit(2)).alias("type"))


JSON_VALUE = "CASE e % 8 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN CAST(u AS STRING) WHEN 3 THEN CAST(ms AS STRING) WHEN 4 THEN '1.5e3' WHEN 5 THEN props WHEN 6 THEN '[1]' ELSE '\"' || t || '\"' END"
derive("json_values", f"SELECT e, u % 6 AS g, {JSON_VALUE} AS val FROM ev")
JSON_TYPE = "CASE e % 8 WHEN 0 THEN 'TEXT' WHEN 1 THEN 'BOOLEAN' WHEN 2 THEN 'INTEGER' WHEN 3 THEN 'BIGINT' WHEN 4 THEN 'DOUBLE' WHEN 5 THEN 'JSONB' WHEN 6 THEN 'JSONB' ELSE 'TEXT' END"


@query("fn_json_type", f"SELECT e, {JSON_TYPE} AS type FROM json_values")
def _(t):
    return t.json_values.select("e", ty.json_type(F.col("val")).alias("type"))


@query("doc_infer_schema", f"SELECT g, CASE WHEN count(DISTINCT ty) = 1 THEN any_value(ty) WHEN bool_or(ty = 'JSONB') THEN 'JSONB' WHEN bool_and(ty IN ('INTEGER', 'BIGINT', 'DOUBLE')) THEN CASE WHEN bool_or(ty = 'DOUBLE') THEN 'DOUBLE' WHEN bool_or(ty = 'BIGINT') THEN 'BIGINT' ELSE 'INTEGER' END ELSE 'TEXT' END AS type, count(*) AS rows FROM (SELECT CASE WHEN e % 8 IN (2, 3) THEN 6 WHEN e % 8 IN (2, 4) THEN 7 WHEN e % 8 = 1 THEN 8 ELSE g END AS g, {JSON_TYPE} AS ty FROM json_values) GROUP BY 1")
def _(t):
    g = F.when((F.col("e") % 8).isin(2, 3), 6).when((F.col("e") % 8).isin(2, 4), 7).when(F.col("e") % 8 == 1, 8).otherwise(F.col("g"))
    return ty.infer_schema(t.json_values.withColumn("g", g), "g", "val")


@query("fn_row_sample", "SELECT e, '{\"user\":\"' || u || '\",\"type\":\"' || left(t, 3) || '\"}' AS sample FROM ev")
def _(t):
    entries = F.array(*[F.struct(F.lit(k).alias("key"), x.alias("value")) for k, x in (("user", F.col("u").cast("string")), ("type", F.col("t")), ("cents", F.col("cents").cast("string")))])
    return t.ev.select("e", c.row_sample(F.transform(entries, lambda x: F.struct(x["key"].alias("key"), F.when(x["key"] == "type", F.substring(x["value"], 1, 3)).otherwise(x["value"]).alias("value"))), 2).alias("sample"))
