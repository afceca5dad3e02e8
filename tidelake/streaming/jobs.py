"""Structured Streaming jobs over change logs.

Each micro-batch is evaluated once, then applied by foreachBatch: the lake's merge first, then the ledger. A batch's
number is the lake's version and names the folders that it writes, so a batch that Spark runs again after a failure
finds done what is done, and writes what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import apply as a
from ..sources.lake import LakeTable
from ..sources.scratch import empty


LEDGER = "catalog_id long, event_id string, digest long, batch long"


@contextmanager
def once_read(batch: DataFrame):
    """The batch, held while it is used several times."""
    held = batch.persist()
    try:
        yield held
    finally:
        held.unpersist()


def _before(table: LakeTable, path: str, schema: str, number: int) -> DataFrame:
    """What batches before this one have written."""
    spark = table.spark
    rows = spark.read.schema(schema).parquet(path) if table.exists(path) else empty(spark, schema)
    return rows.where(F.col("batch") < number)


def stream_apply(changes: DataFrame, table: LakeTable, data: list[str], checkpoint: str, ledger: str | None = None, once: bool = True) -> StreamingQuery:
    """Apply a stream of changes to a lake table; with a ledger, events that it holds are passed over.

    The ledger has a folder for each batch, written after the lake's merge whether or not the merge was done before: a
    batch that stopped in between finds the same rows new again and completes it.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = a.dedup(batch, _before(table, ledger, LEDGER, number)) if ledger else batch
        with once_read(rows) as new:
            table.merge(new, data, number)
            if ledger:
                a.ledger_rows(new).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_retries(work: Callable[[], None], attempts: int = 3, pause_ms: int = 100) -> None:
    """Run work again after an error, pausing twice as long each time; the last error is raised."""
    import time

    for n in range(attempts):
        try:
            return work()
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(pause_ms * 2**n / 1000)


def stream_dedup(changes: DataFrame, time: str, delay: str) -> DataFrame:
    """Changes each once, as far apart as the watermark's delay: by their id and by what they say, as apply.dedup has it,
    so two changes that share an id both stay."""
    keyed = changes.withColumn("digest", a.digest(changes.drop(time))).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(list(a.IDENTITY)).drop("digest")


def stream_counts(changes: DataFrame, time: str, delay: str, width: str = "1 hour") -> DataFrame:
    """Events of each tumbling window and table, once the watermark has passed it."""
    return changes.withWatermark(time, delay).groupBy(F.window(time, width), "catalog_id").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "catalog_id", "events")


def transactions(markers: DataFrame) -> DataFrame:
    """Whole transactions of a finished log, from their begin, data and commit records (tx, kind, ts_ms); see transactions.assemble."""
    return markers.groupBy("tx").agg(F.count_if(F.col("kind") == "data").alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.bool_or(F.col("kind") == "commit").alias("done")).where("done").drop("done")


def stream_quarantine(changes: DataFrame, table: LakeTable, data: list[str], bad: Callable[[DataFrame], DataFrame], held: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream, but keep back the changes of failing tables: bad gives the tables that a batch fails for.

    A table that was held in an earlier batch stays held, so no later change passes those that wait.
    """

    def run(batch: DataFrame, number: int) -> None:
        with once_read(batch) as new:
            before = _before(table, held, "catalog_id long, batch long", number).select("catalog_id")
            with once_read(bad(new).select("catalog_id").union(before).distinct()) as failing:  # a row for each held table
                table.merge(new.join(failing, "catalog_id", "left_anti"), data, number)
                new.join(failing, "catalog_id", "left_semi").write.mode("overwrite").parquet(f"{held}/batch={number}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
