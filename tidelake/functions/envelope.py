"""Change envelopes: building, lenient decoding, normalising and naming, as column expressions.

An envelope is JSON text. Rows inside it are read as VARIANT, so no schema is needed and nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import TASK_BYTES, spread

#: Bytes that a decoder may skip in front of an envelope.
MOST_SKIPPED = 32
ENGINES = ("mariadb", "mssql", "mongodb")
#: Fields that are read of an envelope, all in one walk over its VARIANT.
ENVELOPE = (
    "op string, db_engine string, source_database string, gtid string, source_schema string, source_table string, schema string, table string, catalog_id bigint, ts_ms bigint, before variant, after variant, "
    "source struct<db_engine string, database string, db string, gtid string, lsn string, table string, collection string, file string, pos bigint, ts_ms bigint, seqval string, resume_token variant>"
)


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def decode(value: Column) -> Column:
    """(v, event_id) of a bus value: the first parse, after 0 to 32 skipped bytes, that is an envelope; null if none is.

    An envelope is an object with an `op`, or a CloudEvent whose data is one; that event's id is kept. Values that parse
    at once never see the other attempts; those try only offsets at which an object begins. Each attempt is an array's
    element, so it is parsed once however often it is looked at.
    """
    raw = value.cast("binary")
    parsed = lambda text: F.when(text.startswith("{"), F.try_parse_json(text))

    def envelope(v: Column) -> Column:
        inner = F.when(get(v, "$.specversion").isNotNull(), F.try_variant_get(v, "$.data", "variant"))
        plain = F.struct(v.alias("v"), F.lit(None).cast("string").alias("event_id"))
        return F.when(get(v, "$.op").isNotNull(), plain).when(get(inner, "$.op").isNotNull(), F.struct(inner.alias("v"), get(v, "$.id").alias("event_id")))

    later = F.transform(F.sequence(F.lit(2), F.lit(MOST_SKIPPED + 1)), lambda at: parsed(raw.substr(at, F.lit(1 << 30)).cast("string")))
    first = lambda tries: F.get(F.filter(F.transform(F.filter(tries, lambda v: v.isNotNull()), envelope), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(first(F.array(parsed(raw.cast("string")))), first(later))


def probe(value: Column) -> Column:
    """VARIANT of the envelope in a bus value, wrapped or not; null if there is none."""
    return decode(value)["v"]


def op_normalize(op: Column) -> Column:
    """c, u, d for row operations by name; u if there is none; anything else as it is."""
    return F.when(op.isNull(), "u").when(op == "INSERT", "c").when(op == "UPDATE", "u").when(op == "DELETE", "d").otherwise(op)


def row_image(op: Column, before: Column, after: Column) -> Column:
    """The image that a change leaves: a delete's before, else the after; {} where it is missing."""
    return F.coalesce(F.when(op == "d", before).otherwise(after), F.lit("{}"))


def fill_before(op: Column, row: Column, before: Column, fill_nulls: bool = False) -> Column:
    """For updates, map row with keys from map before that it lacks; with fill_nulls also those that are null in it."""
    have = F.map_keys(F.map_filter(row, lambda _, v: v.isNotNull())) if fill_nulls else F.map_keys(row)
    extra = F.map_filter(before, lambda k, _: ~F.array_contains(have, k))
    kept = F.map_filter(row, lambda k, _: F.array_contains(have, k) | ~F.array_contains(F.map_keys(before), k))
    return F.when((op == "u") & before.isNotNull(), F.map_concat(kept, extra)).otherwise(row)


def pk_normalize(x: Column) -> Column:
    """A key of digits and dashes as a number's text without leading zeros; other keys as they are."""
    number = F.when(x.rlike("^[0-9-]+$"), x.try_cast("long"))
    return F.coalesce(number.cast("string"), x)


def object_id(value: Column) -> Column:
    """Text of an identifier given as JSON: {"$oid": x}, {"oid": x}, a string, or any other value."""
    v = F.try_parse_json(value)
    return F.coalesce(get(v, "$['$oid']"), get(v, "$.oid"), F.when(value.startswith('"'), get(v, "$")), value)


def event_id(engine: Column, db: Column, gtid: Column, file: Column, pos: Column, seq: Column, schema: Column, table: Column, op: Column, keys: list[tuple[str, Column]], whole: Column) -> Column:
    """`position|schema.table|op|key=value|...`; values as JSON; without keys the whole envelope's text."""
    at = (
        F.when(engine == "mssql", F.concat(F.lit("mssql:"), db, F.lit(":"), F.coalesce(gtid, F.lit("")), F.coalesce(F.concat(F.lit(":"), seq), F.lit(""))))
        .when(engine == "mongodb", F.concat(F.lit("mongo:"), db, F.lit(":"), F.coalesce(gtid, F.lit(""))))
        .otherwise(F.coalesce(gtid, F.concat(F.coalesce(file, F.lit("")), F.lit(":"), F.coalesce(pos, F.lit(0)).cast("string"))))
    )
    part = F.concat_ws("|", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c)) for n, c in keys])
    return F.concat(at, F.lit("|"), schema, F.lit("."), table, F.lit("|"), op, F.lit("|"), F.when(part == "", whole).otherwise(part))


def key_from_event_id(x: Column) -> Column:
    """(schema, table) of an event id."""
    name = F.split(x, r"\|")[1]
    return F.struct(F.substring_index(name, ".", 1).alias("schema_name"), F.substring_index(name, ".", -1).alias("table_name"))


def cloud_event(event: Column, kind: Column, source: Column, subject: Column, time: Column, data: Column) -> Column:
    """CloudEvents 1.0 text around an envelope."""
    fields = F.struct(F.lit("1.0").alias("specversion"), event.alias("id"), source.alias("source"), kind.alias("type"), time.alias("time"), subject.alias("subject"))
    return F.concat(F.regexp_replace(F.to_json(fields), r"\}$", ""), F.lit(',"data":'), data, F.lit("}"))


def unwrap_cloud_event(value: Column) -> Column:
    """The envelope inside a CloudEvent as VARIANT; an envelope that isn't wrapped comes back itself."""
    v = F.try_parse_json(value)
    return F.when(get(v, "$.specversion").isNotNull(), F.try_variant_get(v, "$.data", "variant")).otherwise(v)


def sql_literal(x: Column) -> Column:
    """(kind, text) of a textual SQL literal. A quoted one is told by its two ends, so its length doesn't matter."""
    s = F.trim(x)
    low = F.lower(F.substring(s, 1, 8))
    is_bytes = low.startswith("_binary") | low.startswith("0x") | low.startswith("x'")
    quoted = s.startswith("'") & s.endswith("'") & (F.length(s) >= 2)
    short = F.when(F.length(s) <= 400, s)  # what is longer is no number
    kind = F.when(F.upper(short) == "NULL", "null").when(short.rlike("^[bB]['\"][01]['\"]$"), "bool").when(is_bytes, "bytes").when(quoted, "string").when(short.rlike("^-?[0-9]+$"), "int").when(short.rlike(r"^-?[0-9]*\.[0-9]+([eE][+-]?[0-9]+)?$"), "float").otherwise("raw")
    inner = F.replace(F.substr(s, F.lit(2), F.length(s) - 2), F.lit("''"), F.lit("'"))
    text = F.when(kind == "null", F.lit(None)).when(kind == "bool", F.when(F.substring(s, 3, 1) == "1", "true").otherwise("false")).when(kind == "string", inner).otherwise(s)
    return F.struct(kind.alias("kind"), text.alias("text"))


def tx_id(x: Column) -> Column:
    """A transaction's hex text as a number: its first 15 hex digits; 0 without any."""
    digits = F.substring(F.regexp_replace(x, "[^0-9A-Fa-f]", ""), 1, 15)
    return F.when(digits == "", 0).otherwise(F.conv(digits, 16, 10)).cast("long")


def mongo_tx_id(v: Column) -> Column:
    """(id, transactional) of a change-stream document: its number, else its session, else its cluster time."""
    number = get(v, "$.txnNumber", "long")
    return F.struct(F.coalesce(number, F.when(get(v, "$.lsid.id").isNotNull(), tx_id(get(v, "$.lsid.id"))), get(v, "$.clusterTime.t", "long")).alias("id"), number.isNotNull().alias("transactional"))


def is_ddl(statement: Column) -> Column:
    """Whether a source statement changes a schema: it begins with alt, cre or dro and is long enough to be whole."""
    s = F.lower(F.ltrim(statement))
    n = F.length(s)
    return (s.startswith("alt") & (n >= 5)) | (s.startswith("cre") & (n >= 6)) | (s.startswith("dro") & (n >= 4))


def sanitize(name: Column, most: int = 63) -> Column:
    """A name as a lake identifier."""
    s = F.ltrim(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), F.lit("_"))
    return F.substring(F.regexp_replace(F.regexp_replace(s, "^$", "x"), "^(?=[0-9])", "t_"), 1, most)


def lake_name(engine: Column, database: Column, schema: Column, table: Column) -> Column:
    """(schema, table) in the lake."""
    return F.struct(F.when(engine == "mssql", sanitize(F.concat(database, F.lit("_"), schema))).when(engine == "mongodb", sanitize(database)).otherwise(schema).alias("lake_schema"), F.when(engine.isin("mssql", "mongodb"), sanitize(table)).otherwise(table).alias("lake_table"))


def disambiguate(names: DataFrame, scope: str, raw: str, most: int = 63) -> DataFrame:
    """Add `ident`: the sanitized name, with a suffix from the raw name's hash for all but the first of equal ones."""
    from pyspark.sql import Window

    s = names.withColumn("_s", sanitize(F.col(raw), most))
    w = Window.partitionBy(scope, "_s").orderBy(raw)
    suffix = F.concat(F.lit("_"), F.pmod(F.xxhash64(raw), F.lit(1_000_000_007)).cast("string"))
    return s.withColumn("ident", F.when(F.row_number().over(w) == 1, F.col("_s")).otherwise(F.concat(F.substring(F.col("_s"), 1, most - 12), suffix))).drop("_s")


def message_key(schema: Column, table: Column, pk: str | None, value: Column, kind: str = "string") -> Column:
    """`schema.table`, with the first key column's value behind it; strings quoted, booleans capitalised."""
    base = F.concat(schema, F.lit("."), table)
    if not pk:
        return base
    text = F.concat(F.lit("'"), value, F.lit("'")) if kind == "string" else F.initcap(value.cast("string")) if kind == "boolean" else value.cast("string")
    return F.when(value.isNull(), base).otherwise(F.concat(base, F.lit(f"|{pk}="), text))


def split_columns(x: Column) -> Column:
    """Names of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), lambda c: F.trim(c)), lambda c: c != "")


def json_map(v: Column, path: str) -> Column:
    """Fields of a VARIANT object as a map of JSON texts; null where it isn't an object."""
    return F.transform_values(F.try_variant_get(v, path, "map<string,variant>"), lambda _, x: F.to_json(x))


def json_object(fields: Column) -> Column:
    """Object text of a map of JSON texts, by name."""
    names = F.sort_array(F.map_keys(fields))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(names, lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(fields[k], F.lit("null"))))), F.lit("}"))


def key_json(x: Column) -> Column:
    """JSON text of a key: a string of digits and dashes that is a number becomes one."""
    text = F.when(x.startswith('"'), get(F.try_parse_json(x), "$"))
    number = F.when(text.rlike("^[0-9-]+$"), text.try_cast("long"))
    return F.coalesce(number.cast("string"), x)


def names_from_event_id(x: Column, default_engine: Column) -> Column:
    """(schema, table) in the lake that an event id tells: the engine by its position's prefix, else the given one."""
    at, dotted = F.substring_index(x, "|", 1), F.when(F.size(F.split(x, r"\|")) > 2, F.split(x, r"\|")[1])
    whole = dotted.rlike(r"^[^.]+\..+$")
    engine = F.when(at.startswith("mssql:"), "mssql").when(at.startswith("mongo:"), "mongodb").otherwise(default_engine)
    database = F.when(at.rlike("^(mssql|mongo):[^:]*:"), F.split(at, ":")[1]).otherwise("")
    return F.when(whole, lake_name(engine, database, F.substring_index(dotted, ".", 1), F.regexp_replace(dotted, r"^[^.]+\.", "")))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once even where a filter follows: the optimizer does not copy what a generator
    gives into the conditions that it pushes down."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("_made")
    return df.select(*kept, made).select(*kept, "_made.*")


def parse(messages: DataFrame, keys: tuple[str, ...] = (), default_engine: str = "mariadb", fill_nulls: bool = False, with_skipped: bool = False) -> DataFrame:
    """Bus messages (topic, part, pos, value and, if there is one, the bus timestamp `time`) to changes of lake tables.

    Returns topic, part, pos, op, engine, catalog_id (0 if not told), schema_name and table_name in the lake, gtid (LSN
    or resume token where the engine has these), event_id, ts_ms and row: the image as JSON, with what an update lacks
    from its before image and keys normalised. Names come from the envelope, from its source, or from the event id;
    messages without a value, that are no envelope, or whose table stays unknown, are dropped; with_skipped keeps them, and
    a column `skipped` says `tombstone`, `no_envelope` or `no_table` (null for a change). An event that came wrapped
    keeps its id.
    """
    messages = messages if messages.isStreaming else spread(messages, TASK_BYTES)
    if with_skipped:
        decoded = messages.select("*", F.explode(F.array(decode(F.col("value")))).alias("d"))
    else:
        decoded = messages.where("value is not null").select("*", F.explode(F.filter(F.array(decode(F.col("value"))), lambda d: d.isNotNull())).alias("d"))
    filled = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    e, source = lambda name: F.col(f"x.{name}"), lambda name: F.col(f"x.source.{name}")
    read = decoded.select(
        "topic", "part", "pos", *(["time"] if "time" in messages.columns else []), F.col("value").isNull().alias("empty"), F.col("d").isNull().alias("strange"),
        F.col("d.v").alias("v"), F.col("d.event_id").alias("wrapped_id"), F.try_variant_get("d.v", "$", f"struct<{ENVELOPE}>").alias("x"),
    )
    read = read.withColumns({"op": op_normalize(e("op")), "engine": F.coalesce(e("db_engine"), source("db_engine"), F.lit(default_engine)), "db": F.coalesce(e("source_database"), source("database"), F.lit(""))})
    mssql, mongo = F.col("engine") == "mssql", F.col("engine") == "mongodb"
    own_schema, own_table, gtid = e("source_schema"), e("source_table"), F.coalesce(source("gtid"), e("gtid"))
    token = F.when(mongo, F.nullif(F.to_json(source("resume_token")), F.lit("null")))
    facts = read.select(
        "topic", "part", "pos", "op", "engine", "db", "empty", "strange", "v", "wrapped_id", F.coalesce(e("catalog_id"), F.lit(0)).alias("catalog_id"),
        F.when(mssql, filled(own_schema, source("db"))).when(mongo, F.col("db")).otherwise(filled(own_schema, e("schema"), source("db"))).alias("s"),
        F.when(mssql, filled(own_table, source("table"))).when(mongo, filled(own_table, source("collection"))).otherwise(filled(own_table, e("table"), source("table"))).alias("t"),
        F.when(mssql, F.coalesce(source("lsn"), gtid)).when(mongo, F.coalesce(token, gtid)).otherwise(gtid).alias("gtid"),
        F.when(mssql, F.coalesce(source("lsn"), gtid)).when(mongo, F.coalesce(source("gtid"), token, e("gtid"))).otherwise(gtid).alias("at"),
        source("file").alias("file"), source("pos").alias("file_pos"), source("seqval").alias("seq"),
        F.coalesce(own_schema, source("db"), F.lit("")).alias("own_s"), F.coalesce(own_table, source("table"), F.lit("")).alias("own_t"),
        F.coalesce(e("ts_ms"), source("ts_ms"), F.col("time").cast("long") if "time" in messages.columns else F.lit(None).cast("long")).alias("ts_ms"),
        e("before").alias("before"), F.when(F.col("op") == "d", e("before")).otherwise(e("after")).alias("image"),
    )
    # an image that nothing changes is its own text; the others are opened to maps
    paths = {k: f"$['{k}']" for k in keys if "'" not in k}
    cells = {f"cell_{i}": F.to_json(F.try_variant_get("image", paths[k], "variant")) for i, k in enumerate(keys) if k in paths}
    facts = facts.withColumns({"text": F.to_json("image"), **cells})
    filled_in = (F.col("op") == "u") & F.to_json("before").startswith("{")
    same = F.col("text").startswith("{") & (F.length("text") == F.octet_length("text")) & ~F.coalesce(filled_in, F.lit(False)) & F.try_variant_get("image", "$.mongo_id", "variant").isNull()
    for c in cells:
        same &= ~F.coalesce(F.col(c).startswith('"'), F.lit(False))
    facts = facts.withColumn("same", F.coalesce(same, F.lit(False)) if len(cells) == len(keys) else F.lit(False))
    none = lambda m: F.transform_values(m, lambda _, x: F.nullif(x, F.lit("null")))
    image = F.coalesce(json_map(F.col("image"), "$"), F.from_json(F.lit("{}"), "map<string,string>"))
    facts = facts.withColumns({"row": F.when(~F.col("same"), none(image)), "before": F.when(~F.col("same"), none(json_map(F.col("before"), "$")))})
    facts = facts.withColumn("row", fill_before(F.col("op"), F.col("row"), F.col("before"), fill_nulls)).drop("before")
    ids = F.transform_values(F.col("row"), lambda k, x: F.when((k == "mongo_id") & x.isNotNull(), object_id_json(x)).otherwise(x))
    facts = facts.withColumn("row", F.transform_values(ids, lambda k, x: F.when(k.isin(*keys), key_json(x)).otherwise(x)) if keys else ids)
    opened = lambda k: F.when(F.array_contains(F.map_keys("row"), k), F.coalesce(F.col("row")[k], F.lit("null")))
    pairs = [(k, F.when(F.col("same"), F.col(f"cell_{i}")).otherwise(opened(k)) if k in paths else opened(k)) for i, k in enumerate(keys)]
    built = event_id(F.col("engine"), F.col("db"), F.col("at"), F.col("file"), F.col("file_pos"), F.col("seq"), F.col("own_s"), F.col("own_t"), F.col("op"), pairs, F.to_json("v"))
    known = (F.col("s") != "") & (F.col("t") != "")
    named = facts.withColumn("event_id", F.coalesce("wrapped_id", built))
    named = computed(named, n=F.when(known, lake_name(F.col("engine"), F.col("db"), F.col("s"), F.col("t"))).otherwise(names_from_event_id(F.col("event_id"), F.col("engine"))))
    unknown = F.coalesce((F.col("n.lake_schema") == "") | (F.col("n.lake_table") == ""), F.lit(True))
    skipped = F.when(F.col("empty"), "tombstone").when(F.col("strange"), "no_envelope").when(unknown, "no_table").alias("skipped")
    out = named.select("topic", "part", "pos", "op", "engine", "catalog_id", F.col("n.lake_schema").alias("schema_name"), F.col("n.lake_table").alias("table_name"), "gtid", "event_id", "ts_ms", F.when(F.col("same"), F.col("text")).otherwise(json_object(F.col("row"))).alias("row"), *([skipped] if with_skipped else []))
    return out if with_skipped else out.where((F.col("schema_name") != "") & (F.col("table_name") != ""))


def skip_counts(parsed: DataFrame) -> DataFrame:
    """Messages of each topic and partition that came, and how many were skipped for which reason; from parse(with_skipped=True)."""
    n = lambda kind: F.count_if(F.coalesce(F.col("skipped") == kind, F.lit(False)))
    return parsed.groupBy("topic", "part").agg(F.count("*").alias("seen"), n("tombstone").alias("tombstones"), n("no_envelope").alias("no_envelope"), n("no_table").alias("no_table"), F.count("skipped").alias("parse_skipped"))


def object_id_json(x: Column) -> Column:
    """JSON text of an identifier's text, whatever form it has."""
    return F.regexp_replace(F.to_json(F.array(object_id(x))), r"^\[|\]$", "")


def build(op: Column, engine: Column, schema: Column, table: Column, before: Column, after: Column, source: Column) -> Column:
    """Envelope text; before and after are structs or null, source is the engine's struct."""
    return F.to_json(F.struct(op.alias("op"), engine.alias("db_engine"), schema.alias("source_schema"), table.alias("source_table"), before.alias("before"), after.alias("after"), source.alias("source")))


def matches(schema: Column, table: Column, wanted: list[tuple[str, str]]) -> Column:
    """Whether a message is for one of the lake's tables, whatever the case."""
    return reduce(lambda a, b: a | b, [(F.lower(schema) == s.lower()) & (F.lower(table) == t.lower()) for s, t in wanted])
