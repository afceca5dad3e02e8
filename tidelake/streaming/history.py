"""History of a table that batches of changes add to.

Three tables belong together: the versions, by event, so that a key's versions lie in many buckets; the open states, a
row for each key with its last step and its last event; and the log of all changes. A batch whose changes of a key all
come behind the key's last event needs that key's open state alone: the state is the row that the layout begins with.
Only a key with a late change is laid out anew, from the log's buckets of such keys. So what a batch reads grows with the
batch and with what comes late, not with the log or with the history.

The log is written before it is looked at and before the open states, which come last; a batch that stops in between finds the same states again and writes
what is missing.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import history as h
from ..sources.lake import LakeTable
from .jobs import once_read

#: A change's place in the log tells it from others; these columns and those of h.versions are the table's own.
EVENT = ["_part", "_pos"]
SPAN = ["valid_from", "valid_to", "is_current", "is_deleted"]


class HistoryTable:
    """keys, data: columns of the changes; schema: their types. Changes have also op, ts_ms, part and pos.

    Changes with a null in a key are left out, repeated ones make no version, and an empty batch writes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], data: list[str], schema: str, buckets: int | None = None):
        self.spark, self.path, self.keys, self.data = spark, path.rstrip("/"), keys, data
        self.types = T._parse_datatype_string(schema)
        self.all_versions = LakeTable(spark, f"{self.path}/versions", [*keys, *EVENT], f"{schema}, _part int, _pos long, valid_from long, valid_to long, is_current boolean, is_deleted boolean", buckets)
        self.open = LakeTable(spark, f"{self.path}/open", keys, f"{schema}, _part int, _pos long, valid_from long, deleted boolean, _last_at long, _last_part int, _last_pos long", buckets)

    def read(self) -> DataFrame:
        return self.all_versions.read().select(*self.keys, *self.data, *SPAN)

    def _log(self, buckets: list[int], last: int) -> DataFrame:
        """Rows of some of the log's buckets, up to a batch."""
        own = T.StructType([T.StructField("batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(T.StructType([*self.staged_schema.fields, *own.fields])).parquet(f"{self.path}/log")
        return rows.where(F.col("_bucket").isin(buckets) & (F.col("batch") <= last)).drop("batch", "_bucket")

    @property
    def staged_schema(self) -> T.StructType:
        return T.StructType([*self.types.fields, *T._parse_datatype_string("valid_from long, deleted boolean, _part int, _pos long").fields])

    def _staged(self, changes: DataFrame) -> DataFrame:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        rows = h.staged(changes.where(whole), self.keys, self.data).withColumnsRenamed({"part": "_part", "pos": "_pos"})
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.staged_schema.fields])

    def add(self, changes: DataFrame, number: int) -> None:
        """Add a batch; a number that is there already changes nothing."""
        if number <= self.open.version():
            return
        rows = self._staged(changes)
        buckets, touched = self.open.touched(rows)
        if not touched:
            return
        first = self.open.state().first or buckets
        log_bucket = self.open.bucket(first, first)
        # written beside what follows, which looks at the log only for late changes
        with ThreadPoolExecutor(1) as pool:
            logged = pool.submit(rows.withColumn("_bucket", log_bucket).write.mode("overwrite").partitionBy("_bucket").parquet, f"{self.path}/log/batch={number}")
            self._lay(rows, touched, log_bucket, logged, number)

    def _lay(self, rows: DataFrame, touched: list[int], log_bucket: Column, logged: Future, number: int) -> None:
        """Lay out a batch's keys and write versions, then open states; the log is there before it is read and before the states."""
        place = F.struct("valid_from", *EVENT)
        span = rows.groupBy(*self.keys).agg(F.min(place).alias("_least"), F.max(place).alias("_most"))
        last = F.struct(*[F.col(c).alias(n) for c, n in zip(("_last_at", "_last_part", "_last_pos"), ("valid_from", *EVENT), strict=True)])
        # a first event has no state before it
        states = span.join(self.open.read(touched), self.keys, "left").withColumn("_late", F.col("_last_pos").isNotNull() & (last >= F.col("_least")))
        states = states.withColumn("_end", F.when(F.col("_last_pos").isNotNull(), F.greatest("_most", last)).otherwise(F.col("_most")))
        with once_read(states) as keyed:
            late = keyed.where("_late").select(*self.keys)
            behind = [r[0] for r in late.select(log_bucket.alias("b")).distinct().collect()]  # buckets of the log at most
            names = self.staged_schema.names
            heads = keyed.where("not _late and _last_pos is not null").select(*names)
            todo = rows.join(keyed.where("not _late").select(*self.keys), self.keys, "left_semi").select(*names).unionByName(heads)
            if behind:
                logged.result()
                todo = todo.unionByName(self._log(behind, number).join(late, self.keys, "left_semi").select(*names))
            with once_read(h.steps(todo, self.keys, self.data, tuple(EVENT))) as laid:
                found = self._placed(h.versions(laid, self.keys, self.data, *EVENT), "u")
                if behind:
                    before = h.steps(self._log(behind, number - 1).join(late, self.keys, "left_semi").select(*names), self.keys, self.data, tuple(EVENT))
                    old = self._placed(h.versions(before, self.keys, self.data, *EVENT), "d")
                    found = found.unionByName(old.join(found.select(*self.keys, *EVENT), [*self.keys, *EVENT], "left_anti"))
                self.all_versions.merge(found, [*self.data, *SPAN], number)
                ends = keyed.select(*self.keys, F.col("_end.valid_from").alias("_last_at"), F.col("_end._part").alias("_last_part"), F.col("_end._pos").alias("_last_pos"))
                state = laid.where("_next is null").drop("_next").join(ends, self.keys)
                own = [c for c in state.columns if c not in self.keys]
                logged.result()
                self.open.merge(self._placed(state, "u"), own, number)

    @staticmethod
    def _placed(rows: DataFrame, op: str) -> DataFrame:
        """Rows as changes, one for each key of their table."""
        return rows.withColumns({"op": F.lit(op), "part": F.col("_part"), "pos": F.col("_pos")})

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        def run(batch: DataFrame, number: int) -> None:
            with once_read(batch) as new:
                self.add(new, number)

        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
