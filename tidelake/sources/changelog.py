"""Change logs and snapshots in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.envelope import get, object_id
from ..operators.documents import flatten

MESSAGE = T.StructType([T.StructField("topic", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("time", T.LongType())])


def read_messages(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Messages of a change log kept as Parquet; time, the bus timestamp in milliseconds, may be missing there."""
    if not streaming:
        return spark.read.schema(MESSAGE).parquet(path)
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def read_bus(spark: SparkSession, servers: str, topics: str, starting: str = "earliest", streaming: bool = True, most: int | None = None) -> DataFrame:
    """Messages of a Kafka bus; needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics).option("startingOffsets", starting)
    if most and streaming:
        reader = reader.option("maxOffsetsPerTrigger", most)
    return reader.load().select("topic", F.col("partition").alias("part"), F.col("offset").alias("pos"), F.col("key").cast("string"), F.col("value").cast("string"), F.unix_millis("timestamp").alias("time"))


def read_table(spark: SparkSession, url: str, table: str, predicates: list[str], **options: str) -> DataFrame:
    """A source table over JDBC, one task for each slice's predicate."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def snapshot_slices(rows: DataFrame, key: str, slices: list[tuple[int | None, int | None]]) -> DataFrame:
    """The rows of some key slices, as filters that reach the scan."""
    from functools import reduce

    def inside(lo, hi):
        c = F.lit(True)
        c = c & (F.col(key) >= lo) if lo is not None else c
        return c & (F.col(key) < hi) if hi is not None else c

    return rows.where(reduce(lambda a, b: a | b, [inside(*s) for s in slices]))


def mssql_changes(rows: DataFrame) -> DataFrame:
    """SQL Server change rows to changes: 1 is a delete, 2 an insert, 4 an update; old images and __$ columns go."""
    code = F.col("__$operation")
    data = [c for c in rows.columns if not c.startswith("__$")]
    op = F.when(code == 1, "d").when(code == 2, "c").otherwise("u")
    return rows.where(code.isin(1, 2, 4)).select(op.alias("op"), F.lower(F.hex("__$start_lsn")).alias("lsn"), F.lower(F.hex("__$seqval")).alias("seqval"), *data)


def mongo_changes(docs: Column) -> Column:
    """A change-stream document (VARIANT) to (op, id, doc, at): inserts and replaces are c, updates u, deletes d; other
    kinds give a null op. The position is the cluster's time, else the wall's, else the resume token, as JSON. The
    document is whole; flat_changes opens it."""
    kind = get(docs, "$.operationType")
    op = F.when(kind.isin("insert", "replace"), "c").when(kind == "update", "u").when(kind == "delete", "d")
    part = lambda path: F.to_json(F.try_variant_get(docs, path, "variant"))
    at = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(docs, "$.clusterTime", "variant")).startswith("OBJECT"), part("$.clusterTime")), part("$.wallTime"), part("$._id"))
    return F.struct(op.alias("op"), object_id(part("$.documentKey._id")).alias("id"), F.when(op != "d", F.try_variant_get(docs, "$.fullDocument", "variant")).alias("doc"), at.alias("at"))


def flat_changes(rows: DataFrame, id_col: str, docs: str) -> DataFrame:
    """Change-stream documents to changes (id_col, op, id, at, row): row is the flattened document as a map, or for a
    delete its key alone; documents of other kinds are dropped."""
    found = rows.select(id_col, mongo_changes(F.col(docs)).alias("x")).where("x.op is not null").select(id_col, "x.*")
    cells = flatten(found.where("doc is not null").select(id_col, "doc"), id_col, "doc")
    flat = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("row"))  # one document's leaves
    key = F.when(F.col("op") == "d", F.create_map(F.lit("mongo_id"), F.col("id")))
    return found.drop("doc").join(flat, id_col, "left").select(id_col, "op", "id", "at", F.coalesce(key, "row").alias("row"))


def row_events(rows: DataFrame) -> DataFrame:
    """Row-change records (kind, cols, vals, olds) to changes with their images as maps."""
    kind = F.upper("kind")
    op = F.when(kind == "INSERT", "c").when(kind == "UPDATE", "u").when(kind == "DELETE", "d")
    image = lambda v: F.when(F.col(v).isNotNull(), F.map_from_arrays("cols", v))
    rest = [c for c in rows.columns if c not in ("kind", "cols", "vals", "olds")]
    return rows.where(op.isNotNull()).select(*rest, op.alias("op"), F.when(op != "d", image("vals")).alias("after"), F.when(op != "c", image("olds")).alias("before"))


def to_messages(changes: DataFrame, topic: Column, part: Column, key: Column, value: Column) -> DataFrame:
    """Messages of changes, and behind each delete a tombstone: the same key without a value."""
    rows = changes.select(topic.alias("topic"), part.alias("part"), key.alias("key"), value.alias("value"), F.col("op"), F.col("pos"))
    both = F.when(F.col("op") == "d", F.array(F.struct(F.lit(0).alias("after"), F.col("value").alias("v")), F.struct(F.lit(1).alias("after"), F.lit(None).cast("string").alias("v")))).otherwise(F.array(F.struct(F.lit(0).alias("after"), F.col("value").alias("v"))))
    return rows.select("topic", "part", "pos", "key", F.explode(both).alias("m")).select("topic", "part", "pos", "key", F.col("m.v").alias("value"), (F.col("m.after") == 1).alias("tombstone"))


def write_mirror(rows: DataFrame, path: str, time: str = "_dl_load_ms", mode: str = "overwrite") -> None:
    """A mirror, one folder for each month of its load time."""
    month = F.date_format(F.timestamp_millis(time), "yyyy_MM")
    rows.withColumn("_dl_month", month).write.mode(mode).partitionBy("_dl_month").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Append to a bookkeeping table."""
    rows.write.mode("append").parquet(path)
