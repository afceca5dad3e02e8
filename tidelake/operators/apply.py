"""Applying a change log to mirrors.

A change has: topic, part, pos (its place in the log), op (c, u, d), catalog_id, key columns and data columns. Of the
changes of one key the last by (part, pos) wins, a delete included; option deletes_first applies all deletes before
all upserts instead. All steps are aggregates with partial combine and equi-joins on the key, so a batch is replayed
without effect and deals out by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, scratch_path

PLACE = ("part", "pos")


def place() -> Column:
    return F.struct(*PLACE)


IDENTITY = ("catalog_id", "event_id", "digest")


def digest(changes: DataFrame) -> Column:
    """Hash of what a change says, wherever and whenever it was delivered."""
    return F.xxhash64(*[F.col(c) for c in sorted(changes.columns) if c not in ("topic", "ts_ms", "digest", "batch", *PLACE)])


def ledger_rows(changes: DataFrame) -> DataFrame:
    """What a ledger keeps of applied changes."""
    return changes.select("catalog_id", "event_id", digest(changes).alias("digest"))


def dedup(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Changes that the ledger of applied ones doesn't hold, each once, where it came first.

    A message that is delivered or sent again has the same event id and says the same. Two changes that share an id, as
    those of one log event named by file and position do, say different things and both stay.
    """
    rest = [c for c in changes.columns if c not in IDENTITY]
    new = changes.withColumn("digest", digest(changes)).join(ledger.select(*IDENTITY), list(IDENTITY), "left_anti")
    return new.groupBy(*IDENTITY).agg(F.min_by(F.struct(*rest), F.struct("topic", *PLACE)).alias("c")).select("catalog_id", "event_id", "c.*").select(*changes.columns)


def missing_key(changes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Changes whose key columns are all there, and the others."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return changes.where(whole), changes.where(~whole)


def missing_key_counts(changes: DataFrame, keys: list[str]) -> DataFrame:
    lost = ~reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return changes.groupBy("catalog_id").agg(F.count_if(lost & (F.col("op") == "d")).alias("lost_deletes"), F.count_if(lost & (F.col("op") != "d")).alias("lost_upserts"), F.count_if(~lost).alias("kept"))


def latest_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key: a hash aggregate, partial then final."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), place()).alias("c")).select(*keys, "c.*").select(*changes.columns)


def survivors(changes: DataFrame, keys: list[str], order: str = "last_wins") -> tuple[DataFrame, DataFrame]:
    """(upserts, keys to remove): what a batch leaves of each key."""
    if order == "deletes_first":
        return latest_per_key(changes.where("op <> 'd'"), keys), changes.where("op = 'd'").select(*keys).distinct()
    last = latest_per_key(changes, keys)
    return last.where("op <> 'd'"), last.where("op = 'd'").select(*keys)


def delete(mirror: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return mirror.join(removed.select(*keys).distinct(), keys, "left_anti")


def upsert(mirror: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed replace; columns that only one side has are null on the other."""
    return mirror.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def apply_batch(mirror: DataFrame, changes: DataFrame, keys: list[str], data: list[str], order: str = "last_wins") -> DataFrame:
    """The mirror after a batch: touched keys leave it by one anti-join, survivors enter."""
    good, _ = missing_key(changes, keys)
    upserts, removed = survivors(good, keys, order)
    rows = upserts.select(*keys, *data)
    touched = rows.select(*keys).union(removed) if order == "last_wins" else rows.select(*keys).union(removed).distinct()
    return mirror.join(touched, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def load_columns(rows: DataFrame, time: str, source: str, snapshot: str, scope: str = "catalog_id") -> DataFrame:
    """Stamp rows: load time in milliseconds (the event's plus the row's number in its table's batch, so unique
    versions sort), its date, source system and snapshot. Rows are numbered within a table's partition of the bus, behind
    the rows of the partitions before it, so a hot table is several tasks."""
    sizes = rows.groupBy(F.col(scope).alias("_scope"), F.col("part").alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_scope").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a table
    before = sizes.select("_scope", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    numbered = rows.join(before, F.col(scope).eqNullSafe(F.col("_scope")) & F.col("part").eqNullSafe(F.col("_part")))
    nth = F.row_number().over(Window.partitionBy(scope, "part").orderBy("pos")) - 1
    ms = F.col(time) + F.col("_before") + nth
    return numbered.withColumn("_dl_load_ms", ms).drop("_scope", "_part", "_before").withColumns({"_dl_load_date": F.date_format(F.timestamp_millis("_dl_load_ms"), "yyyy-MM-dd"), "_dl_source_system": F.lit(source), "_dl_snapshot_id": F.lit(snapshot)})


def new_columns(known: list[str], rows: DataFrame, fields: str) -> DataFrame:
    """Keys of a map column that are not columns yet and don't belong to the bookkeeping, with how many rows have them."""
    keys = rows.select(F.explode(F.map_keys(fields)).alias("name")).groupBy("name").agg(F.count("*").alias("rows"))
    return keys.where(~F.col("name").isin(*known) & ~F.col("name").startswith("_dl_"))


def widen_ints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row per 32-bit column: whether its values need 64 bits."""
    stats = rows.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce((F.col(f"{c}.lo") < -(2**31)) | (F.col(f"{c}.hi") > 2**31 - 1), F.lit(False)).alias("widen")) for c in columns])).alias("x")).select("x.*")


def check_rows(rows: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Add _errors: rule name and error class of each rule (a condition that must hold) that a row breaks."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(state).alias("sqlstate"))) for n, (ok, state) in rules.items()]
    return rows.withColumn("_errors", F.filter(F.array(*found), lambda e: e.isNotNull()))


def dlq_split(checked: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that apply, rows to park, tables with more parked rows than the limit, which are quarantined)."""
    bad = checked.where(F.size("_errors") > 0)
    over = bad.groupBy("catalog_id").agg(F.count("*").alias("parked")).where(F.col("parked") > limit)
    return checked.where(F.size("_errors") == 0).drop("_errors"), bad, over


def deterministic(sqlstate: Column, message: Column) -> Column:
    """Whether an error can never clear: by its class, else by what its message says."""
    state = F.coalesce(sqlstate, F.lit(""))
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = F.substring(state, 1, 2)
    transient = state.isin("40001", "40P01", "55P03", "57014") | kind.isin("08", "53", "57", "58")
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    by_text = ~has("connection", "server closed", "broken pipe", "timeout", "eof", "reset") & has("violates", "invalid input syntax", "value too long", "out of range", "cannot be cast")
    return F.when(transient, False).when(state != "", kind.isin("22", "23")).otherwise(by_text)


def op_counts(changes: DataFrame, by: list[str]) -> DataFrame:
    d, u = F.col("op") == "d", F.col("op") == "u"
    return changes.groupBy(*by).agg(F.count_if(~d & ~u).alias("inserts"), F.count_if(u).alias("updates"), F.count_if(d).alias("deletes"))


def positions(changes: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Where each table stands after a batch: its change with the highest (pos, part); held tables don't move."""
    rows = changes.join(quarantined.select("catalog_id").distinct(), "catalog_id", "left_anti")
    return rows.groupBy("catalog_id").agg(F.max_by(F.struct("topic", "part", "pos", "event_id"), F.struct("pos", "part")).alias("p"), F.max("ts_ms").alias("last_ms")).select("catalog_id", "p.*", "last_ms")


def batch_stats(changes: DataFrame, started_ms: int, ended_ms: int) -> DataFrame:
    """A row per table that had changes: counts, duration and events a minute."""
    ms = max(ended_ms - started_ms, 1)
    return op_counts(changes, ["catalog_id"]).withColumn("events_total", F.expr("inserts + updates + deletes")).where("events_total > 0").withColumns({"duration_ms": F.lit(ms).cast("long"), "events_per_minute": F.expr(f"events_total * 60000L div {ms}L")})


def commit_offsets(changes: DataFrame, dirty: DataFrame) -> DataFrame:
    """The highest processed place of each partition, dirty partitions left out."""
    done = changes.groupBy("topic", "part").agg(F.max("pos").alias("pos"))
    return done.join(dirty.select("topic", "part").distinct(), ["topic", "part"], "left_anti")


def quarantine_hold(commits: DataFrame, held: DataFrame) -> DataFrame:
    """Commits capped below the first change of a held table; a hold at 0 leaves nothing to commit."""
    first = held.groupBy("topic", "part").agg(F.min("pos").alias("hold"))
    return commits.join(first, ["topic", "part"], "left").where(F.coalesce(F.col("hold") > 0, F.lit(True))).withColumn("pos", F.least("pos", F.coalesce(F.col("hold") - 1, F.col("pos")))).drop("hold")


def replay_plan(positions_: DataFrame) -> DataFrame:
    """Where to start each partition over for tables whose replay was asked for."""
    return positions_.where("replay_requested").groupBy("kafka_topic", "kafka_partition").agg(F.min("kafka_offset").alias("start_offset"), F.count("*").alias("tables"))


def reselect(upserts: DataFrame, current: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """Upserts whose null columns take the source row's present values."""
    now = current.select(*keys, *[F.col(c).alias(f"_now_{c}") for c in data])
    joined = upserts.join(now, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_now_{c}") for c in data}).select(*upserts.columns)


def audit(changes: DataFrame, batch_id: str) -> DataFrame:
    return changes.select("catalog_id", "event_id", "op", "topic", "part", "pos", F.lit(batch_id).alias("batch_id"))


def table_levels(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables with their level, parents first; those in or behind a cycle get null. edges: child, parent.

    Each round takes the edges of parents that the last one settled away; tables without an edge left are settled. What
    a round finds is written, so plans stay short; rounds are as many as the longest chain has tables.
    """
    names = tables.select("name").distinct()
    out = scratch_path(tables.sparkSession, "levels")
    waiting = materialize(edges.where("child <> parent").distinct(), "edges")
    ready = names.join(waiting.select(F.col("child").alias("name")), "name", "left_anti")
    n = 0
    while True:
        ready.write.parquet(f"{out}/level={n}")
        ready = tables.sparkSession.read.schema(names.schema).parquet(f"{out}/level={n}")
        if ready.isEmpty():
            break
        left = materialize(waiting.join(ready.select(F.col("name").alias("parent")), "parent", "left_anti"), "edges")
        ready = waiting.select(F.col("child").alias("name")).distinct().join(left.select(F.col("child").alias("name")), "name", "left_anti")
        waiting = left
        n += 1
    levels = tables.sparkSession.read.schema(T.StructType([*names.schema.fields, T.StructField("level", T.IntegerType())])).parquet(out)
    return names.join(levels, "name", "left")


def newest_version(mirror: DataFrame, keys: list[str], time: str) -> DataFrame:
    """One row of each key: the one with the newest load time."""
    rest = [c for c in mirror.columns if c not in keys]
    return mirror.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("c")).select(*keys, "c.*").select(*mirror.columns)


def reconcile(source: DataFrame, mirror: DataFrame, by: list[str]) -> DataFrame:
    """Rows of source and mirror by group, and the difference."""
    a, b = source.groupBy(*by).agg(F.count("*").alias("source_rows")), mirror.groupBy(*by).agg(F.count("*").alias("mirror_rows"))
    return a.join(b, by, "full").fillna(0, ["source_rows", "mirror_rows"]).withColumn("delta", F.col("source_rows") - F.col("mirror_rows"))


def key_diff(source: DataFrame, mirror: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = source.select(*keys), mirror.select(*keys)
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("source")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("mirror")))
