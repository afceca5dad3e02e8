"""Document collections to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.envelope import sanitize
from ..sources.scratch import TASK_BYTES, materialize, spread


#: Stands in front of each key of a path.
STEP = "\x01"
#: Different paths up to which their names are broadcast.
MOST_SENT = 100_000


#: Levels that every document is opened by; only what is open still asks how deep it can be.
USUAL_DEPTH = 10
LEAVES = "array<struct<path:string,value:string>>"


def leaves(doc: Column) -> Column:
    """Leaves of a VARIANT object: array of (path, value), null for what is no object. Arrays are leaves, as JSON.

    A fold within the row: each step opens the objects that the step before found. A document that is deeper than usual
    itself says how many steps there can be (by the braces of what is open), so it costs no other one anything. Of all
    `_id` only one stays, as path `_id`: the outermost, else that of the first object that has one.
    """
    fields = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    is_object = lambda v: F.try_variant_get(v, "$", "struct<>").isNotNull()
    is_id = lambda n: n["path"].endswith(STEP + "_id")
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))
    own_id = lambda v: F.coalesce(F.try_variant_get(v, "$['$oid']", "string"), F.try_variant_get(v, "$", "string"), F.to_json(v))
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # x is evaluated once in f
    below = lambda path, v: F.transform(fields(v), lambda e: F.struct(F.concat(path, F.lit(STEP), e["key"]).alias("path"), e["value"].alias("v"), ((e["key"] != "_id") & is_object(e["value"])).alias("open")))

    def step(acc: Column, _: Column) -> Column:
        opened, closed = F.filter(acc["nodes"], lambda n: n["open"]), F.filter(acc["nodes"], lambda n: ~n["open"])
        found = F.transform(closed, lambda n: F.struct(n["path"].alias("path"), F.when(is_id(n), own_id(n["v"])).otherwise(text(n["v"])).alias("value")))
        more = F.struct(F.flatten(F.transform(opened, lambda n: below(n["path"], n["v"]))).alias("nodes"), F.concat(acc["done"], found).alias("done"))
        return F.when(F.size(acc["nodes"]) > 0, more).otherwise(acc)

    def one_id(done: Column) -> Column:
        # a path's end sorts before its continuations, so an object's own id comes before those below it
        ids = F.transform(F.filter(done, is_id), lambda n: F.struct(F.concat(n["path"].substr(F.lit(1), F.length(n["path"]) - 3), F.lit(STEP)).alias("at"), n["value"].alias("value")))
        rest = F.filter(done, lambda n: ~is_id(n))
        own = lambda f: F.array(F.struct(F.lit(STEP + "_id").alias("path"), f["value"].alias("value")))
        return once(F.array_min(ids), lambda f: F.when(f.isNull(), rest).otherwise(F.concat(rest, own(f))))

    def braces(nodes: Column) -> Column:
        return F.aggregate(nodes, F.lit(1), lambda n, x: n + once(F.to_json(x["v"]), lambda t: F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))))

    steps = lambda n, start, end: F.aggregate(F.sequence(F.lit(1), n), start, step, end)
    start = F.struct(below(F.lit(""), doc).alias("nodes"), F.array().cast(LEAVES).alias("done"))
    usual = steps(F.lit(USUAL_DEPTH), start, lambda acc: acc)
    whole = once(usual, lambda acc: F.when(F.size(acc["nodes"]) == 0, acc["done"]).otherwise(steps(braces(acc["nodes"]), acc, lambda x: x["done"])))
    return F.when(is_object(doc), once(whole, one_id))


def leaf_name(path: Column) -> Column:
    """A path's keys, joined by `_`, as a lake identifier; `_id` is `mongo_id`, and a first key without letter or digit is x."""
    keys = F.split(F.substring(path, 2, 1 << 30), STEP)
    first = F.when(F.get(keys, F.lit(0)).rlike("[A-Za-z0-9]"), F.get(keys, F.lit(0))).otherwise("x")
    rest = F.slice(keys, F.lit(2), F.greatest(F.size(keys) - 1, F.lit(0)))
    return F.when(path == STEP + "_id", "mongo_id").otherwise(sanitize(F.concat_ws("_", first, rest)))


def flatten(docs: DataFrame, id_col: str, doc: str, name_col: str = "name", value_col: str = "value") -> DataFrame:
    """(id, name, value) of each leaf of a VARIANT column: names joined by `_`, arrays kept whole as JSON.

    `_id` becomes `mongo_id`, the text of its `$oid` if it has one; only the outermost counts. Objects are opened however
    deep they lie, and strings are never searched, so values may hold any characters and have any length. Of different
    paths that come to one name, all but the first get a suffix from the path's hash, the same in every document. Empty objects
    and documents that are no objects have no leaves. The id column may have any name; its rows keep their number of leaves
    if they repeat.
    """
    rows = spread(docs.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.col(doc).alias("doc")), TASK_BYTES).select("key", F.explode(leaves(F.col("doc"))).alias("leaf"))
    held = materialize(rows.select("key", "leaf.path", "leaf.value"), "leaves")
    # as many rows as there are different paths
    paths = materialize(held.select("path").distinct().withColumn("name", leaf_name(F.col("path"))), "paths")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    other = F.concat(F.substring("name", 1, 54), F.lit("_"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8))
    names = paths.select("path", F.when(nth > 1, other).otherwise(F.col("name")).alias("name"))
    if paths.limit(MOST_SENT + 1).count() <= MOST_SENT:
        names = F.broadcast(names)
    return held.join(names, "path").select(F.col("key.id").alias(id_col), F.col("name").alias(name_col), F.col("value").alias(value_col))


def merge_schema(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Known (name, type) with a batch's: each column's type after, and whether it was added or widened."""
    ranks = {"SMALLINT": 1, "INTEGER": 2, "BIGINT": 3, "NUMERIC": 4, "DOUBLE": 5}
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[c], F.lit(0))
    a, b = known.withColumnRenamed("type", "old"), batch.withColumnRenamed("type", "new")
    rows = a.join(b, "name", "full")
    old, new = F.col("old"), F.col("new")
    numbers = (rank(old) > 0) & (rank(new) > 0)
    out = F.when(old.isNull(), new).when(new.isNull() | (old == new), old).when(numbers, F.when(rank(new) > rank(old), new).otherwise(old)).when((old == "JSONB") | (new == "JSONB"), "JSONB").otherwise("TEXT")
    return rows.select("name", out.alias("type"), F.when(old.isNull(), "added").when(out != old, "widened").otherwise("kept").alias("change"))


def pivot(docs: DataFrame, id_col: str, doc: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Documents as a wide table: name to (path, type); values that don't fit are null."""
    return docs.select(id_col, *[F.try_variant_get(doc, path, kind).alias(n) for n, (path, kind) in columns.items()])


def lineage_event(kind: str, job: str, run: Column, inputs: list[tuple[str, str]], outputs: list[tuple[str, str]]) -> Column:
    """A run event with the tables it read and wrote."""
    names = lambda xs: F.array(*[F.struct(F.lit(n).alias("namespace"), F.lit(t).alias("name")) for n, t in xs])
    return F.struct(F.lit(kind).alias("event_type"), F.lit(job).alias("job_name"), run.alias("run_id"), names(inputs).alias("inputs"), names(outputs).alias("outputs"))
