"""One stream from raw bus messages to everything that a batch of changes leaves behind.

A batch is parsed, its messages are counted as skipped or resolved to tables of the catalog, checked, parked or held, and
what the ledger doesn't know is applied. Its steps are written in a fixed order, each in a way that doing it again changes
nothing: mirrors, history, ledger, dead letters and held changes, positions, stats, and last the offsets, which are the
batch's commit record. A run that stops between any two steps is completed by the next.

A table whose changes fail too often is held: from then on all its changes wait, and offsets stay below the first of
them. A released table's waiting changes are applied with those of the next batch, in log order.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.envelope import computed, parse
from ..operators import apply as a
from ..sources.lake import LakeTable
from ..sources.ledger import Ledger
from ..sources.scratch import empty
from .history import HistoryTable
from .jobs import once_read

CHANGE = "topic string, part int, pos long, op string, engine string, catalog_id long, schema_name string, table_name string, gtid string, event_id string, ts_ms long, row string"
#: Tables of a batch that are merged at the same time.
TABLES_AT_ONCE = 4
#: Lake types of the types that a batch's JSON values have; others, as objects and arrays, are kept as text.
LAKE_TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date"}


def columns_of(schema: str) -> dict[str, str]:
    """Column names and lake types of a batch's merged JSON schema, `OBJECT<a: BIGINT, ...>`; columns without a value are left out."""
    out, depth, at, parts = {}, 0, 0, []
    body = schema[schema.index("<") + 1 : -1] if "<" in schema else ""
    for i, c in enumerate(body):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(body[at:i])
            at = i + 1
    for part in [*parts, body[at:]] if body else []:
        name, kind = part.strip().rsplit(": ", 1) if not part.strip().endswith(">") else part.strip().split(": ", 1)
        if kind != "VOID":
            out[name.strip("`").replace("``", "`")] = LAKE_TYPES.get(kind, "double" if kind.startswith("DECIMAL") and not kind.endswith(",0)") else "decimal(38,0)" if kind.startswith("DECIMAL") else "string")
    return out


@dataclass
class Pipeline:
    """A catalog's tables in one place. catalog: catalog_id, schema_name, table_name and pk (array of key columns, all text or
    numbers); root: the folder of all tables; limit: parked changes of a table in a batch beyond which it is held; check: adds
    rules (name to condition and error class) that rows must pass; history: keys and data of the tables that have one."""

    spark: SparkSession
    root: str
    catalog: DataFrame
    key_type: str = "bigint"
    limit: int = 50
    rules: dict = field(default_factory=dict)
    history: dict[int, list[str]] = field(default_factory=dict)
    after_step: Callable[[str], None] = lambda step: None

    # ------------------------------------------------------------ tables

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def mirror(self, catalog_id: int, keys: list[str]) -> LakeTable:
        return LakeTable(self.spark, self.path(f"mirror/{catalog_id}"), keys, ", ".join(f"`{k}` {self.key_type}" for k in keys))

    def history_table(self, catalog_id: int, keys: list[str]) -> HistoryTable:
        data = self.history[catalog_id]
        types = [*[(k, self.key_type) for k in keys], *[(c, "string") for c in data]]
        return HistoryTable(self.spark, self.path(f"history/{catalog_id}"), keys, data, ", ".join(f"`{c}` {t}" for c, t in types))

    def ledger(self) -> Ledger:
        return Ledger(self.spark, self.path("ledger"))

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """What batches have written to a table of bookkeeping, with the column batch."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        rows = self.spark.read.schema(schema + ", batch long").parquet(self.path(name)) if there else empty(self.spark, schema + ", batch long")
        return rows.where(F.col("batch") < before) if before is not None else rows

    def _put(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch={number}")
        self.after_step(name)

    # ------------------------------------------------------------ holding

    def release(self, ids: list[int]) -> None:
        """Let held tables go on: their waiting changes are applied with the next batch."""
        self.spark.createDataFrame([(i,) for i in ids], "catalog_id long").write.mode("append").parquet(self.path("requests"))

    def _released(self, number: int) -> DataFrame:
        """Tables that this batch releases: asked for, and held when it begins. Fixed by the batch's first run."""
        asked = self.spark.read.schema("catalog_id long").parquet(self.path("requests")).distinct() if self._there("requests") else empty(self.spark, "catalog_id long")
        if not self._there(f"released/batch={number}"):
            done = self.table("released", "catalog_id long, asked long", number).groupBy("catalog_id").agg(F.max("asked").alias("done"))
            times = self.spark.read.schema("catalog_id long").parquet(self.path("requests")).groupBy("catalog_id").agg(F.count("*").alias("asked")) if self._there("requests") else asked.withColumn("asked", F.lit(0).cast("long"))
            open_ = times.join(done, "catalog_id", "left").where(F.col("asked") > F.coalesce("done", F.lit(0))).select("catalog_id", "asked")
            open_.join(self.held_tables(number), "catalog_id", "left_semi").write.mode("overwrite").parquet(f"{self.path('released')}/batch={number}")
        return self.spark.read.schema("catalog_id long, asked long").parquet(f"{self.path('released')}/batch={number}").select("catalog_id")

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and (not name.startswith("released/") or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")))

    def _last_release(self, before: int) -> DataFrame:
        return self.table("released", "catalog_id long, asked long", before).groupBy("catalog_id").agg(F.max("batch").alias("freed"))

    def held_tables(self, before: int) -> DataFrame:
        """Tables that are held when a batch begins; a row for each."""
        holds = self.table("holds", "catalog_id long", before).groupBy("catalog_id").agg(F.max("batch").alias("held"))
        return holds.join(self._last_release(before), "catalog_id", "left").where(F.col("held") >= F.coalesce("freed", F.lit(-1))).select("catalog_id")

    def waiting(self, before: int) -> DataFrame:
        """Changes that wait for the release of their table: those kept since it was last released."""
        held = self.table("held", CHANGE, before).join(self.held_tables(before), "catalog_id", "left_semi")
        return held.join(self._last_release(before), "catalog_id", "left").where(F.col("batch") >= F.coalesce("freed", F.lit(-1))).drop("freed", "batch")

    # ------------------------------------------------------------ a batch

    def _resolved(self, batch: DataFrame) -> DataFrame:
        """Parsed messages with their table's id and missing keys; skipped tells what is no change, known whether it has a table."""
        keys = sorted({k for r in self.catalog.select(F.explode("pk").alias("k")).distinct().collect() for k in [r["k"]]})
        parsed = parse(batch, tuple(keys), with_skipped=True).drop("catalog_id")
        # a row for each table
        names = self.catalog.select("catalog_id", "schema_name", "table_name", "pk")
        rows = parsed.join(F.broadcast(names) if names.count() <= 100_000 else names, ["schema_name", "table_name"], "left")
        rows = computed(rows, v=F.try_parse_json("row"))
        cell = lambda k: F.try_variant_get("v", f"$['{k}']", "variant")
        lacks = reduce(lambda x, y: x | y, [F.array_contains("pk", k) & (cell(k).isNull() | F.is_variant_null(cell(k))) for k in keys], F.lit(False))
        return rows.withColumn("keyless", F.coalesce(lacks, F.lit(False)))

    def run(self, batch: DataFrame, number: int) -> None:
        if self._there(f"offsets/batch={number}/_SUCCESS"):
            return
        names = [f.strip().split()[0] for f in CHANGE.split(", ")]
        with once_read(self._resolved(batch)) as rows:
            released = self._released(number)
            still = self.held_tables(number).join(released, "catalog_id", "left_anti")
            changes = rows.where("skipped is null and catalog_id is not null").select(*names, "keyless", "v")
            again = self.waiting(number).join(released, "catalog_id", "left_semi")
            again = again.select(*names, F.lit(False).alias("keyless"), F.try_parse_json("row").alias("v"))
            held = changes.join(still, "catalog_id", "left_semi")
            open_ = changes.join(still, "catalog_id", "left_anti").unionByName(again)
            rules = {"no_key": (~F.col("keyless"), "23502"), **self.rules}
            with once_read(a.check_rows(open_, rules)) as checked:
                good, bad, over = a.dlq_split(checked, self.limit)
                with once_read(over.select("catalog_id")) as failing:  # a row for each table that fails now
                    good = good.join(failing, "catalog_id", "left_anti")
                    with once_read(self.ledger().unseen(good.drop("v", "keyless"), number).withColumn("v", F.try_parse_json("row"))) as new:
                        self._apply(new, number)
                        self.ledger().add(new.select(*names), number)
                        self.after_step("ledger")
                        parked = bad.join(failing, "catalog_id", "left_anti").select(*names, F.to_json("_errors").alias("errors"))
                        strange = rows.where("skipped is null and catalog_id is null").select(*names, F.lit('[{"rule":"unresolved_table"}]').alias("errors"))
                        self._put(parked.unionByName(strange), "dlq", number)
                        kept = held.select(*names).unionByName(checked.join(failing, "catalog_id", "left_semi").select(*names))
                        self._put(kept, "held", number)
                        self._put(failing, "holds", number)
                        self._put(a.positions(new.unionByName(bad.join(failing, "catalog_id", "left_anti").select(*new.columns)), failing), "positions", number)
                        self._put(self._stats(rows, open_, parked, new), "stats", number)
                        self._put(self._offsets(rows, number), "offsets", number)

    def _apply(self, new: DataFrame, number: int) -> None:
        """Merge each table's changes into its mirror; a batch has a row here for each table."""
        found = new.groupBy("catalog_id").agg(F.schema_of_variant_agg("v").alias("schema")).join(self.catalog.select("catalog_id", "pk"), "catalog_id").collect()
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            list(pool.map(lambda r: self._apply_table(new, number, r["catalog_id"], list(r["pk"]), columns_of(r["schema"])), found))

    def _apply_table(self, new: DataFrame, number: int, catalog_id: int, keys: list[str], kinds: dict[str, str]) -> None:
        lake = self.mirror(catalog_id, keys)
        known = {f.name: f.dataType.simpleString() for f in lake.state().schema.fields}
        # a column keeps its type unless the batch's is a wider one of its kind
        kinds = {c: k if c not in known or (known[c], k) in (("int", "bigint"), ("bigint", "double")) else known[c] for c, k in kinds.items()} | {k: self.key_type for k in keys}
        cell = lambda c, k: F.try_variant_get("v", f"$['{c}']", k).alias(c)
        mine = new.where(F.col("catalog_id") == catalog_id)
        place = ["part", "pos", "op", "ts_ms"]
        lake.merge(mine.select(*place, *[cell(c, k) for c, k in kinds.items()]), [c for c in kinds if c not in keys], number)
        self.after_step(f"mirror {catalog_id}")
        if catalog_id in self.history:
            data = self.history[catalog_id]
            own = mine.select(*place, *[cell(k, self.key_type) for k in keys], *[cell(c, "string") for c in data])
            self.history_table(catalog_id, keys).add(own, number)
            self.after_step(f"history {catalog_id}")

    def _stats(self, rows: DataFrame, opened: DataFrame, parked: DataFrame, new: DataFrame) -> DataFrame:
        """A row for each table: messages seen, applied by kind, parked, and passed over as applied before; skipped messages
        have no table."""
        n = lambda df, name: df.groupBy("catalog_id").agg(F.count("*").alias(name))
        out = n(rows, "seen").withColumn("parse_skipped", F.lit(0).cast("long"))
        lost = rows.where("skipped is not null").agg(F.count("*").alias("lost"))
        out = out.crossJoin(F.broadcast(lost)).withColumn("parse_skipped", F.when(F.col("catalog_id").isNull(), F.col("lost")).otherwise(0)).drop("lost")  # one row
        for part in (n(opened, "opened"), n(parked, "parked"), a.op_counts(new, ["catalog_id"])):
            out = out.join(part.withColumnRenamed("catalog_id", "_id"), F.col("catalog_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        out = out.fillna(0, ["opened", "parked", "inserts", "updates", "deletes"])
        return out.select("catalog_id", "seen", "parse_skipped", "parked", "inserts", "updates", "deletes", F.greatest(F.expr("opened - parked - inserts - updates - deletes"), F.lit(0)).alias("dedup_skipped"))

    def _offsets(self, rows: DataFrame, number: int) -> DataFrame:
        """How far each partition is done: below the first change that waits, whichever batch it came with."""
        done = rows.groupBy("topic", "part").agg(F.max("pos").alias("pos"))
        return a.quarantine_hold(done, self.waiting(number + 1).select("topic", "part", "pos"))

    def start(self, messages: DataFrame, checkpoint: str) -> StreamingQuery:
        return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.run).trigger(availableNow=True).start()


STATS = "catalog_id long, seen long, parse_skipped long, parked long, inserts long, updates long, deletes long, dedup_skipped long"
DLQ = CHANGE + ", errors string"
