"""Transactions put together from their begin, data and commit records across batches.

Data records wait in the state store, a list for each transaction, and leave in log order when its commit comes. A
transaction that hears nothing for a time leaves by an event-time timer as unfinished, so state is bounded by what is open
within that time. After its commit a transaction is remembered as closed until its timer, and data that come then leave as
late instead of opening it anew. Rows are passed on one by one, so a long transaction is never held in memory.

State is kept in RocksDB; its provider must be the session's, which `rocksdb` sees to.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "tx long, nth long, pos long, ts_ms long, payload string, status string, first_ms long, last_ms long"
_OUT = Row(*[f.split()[0] for f in OUT.split(", ")])


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Assembler(StatefulProcessor):
    """One transaction: its waiting data, and (n, first, last, timer, closed)."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.data = handle.getListState("data", "pos long, ts_ms long, payload string")
        self.facts = handle.getValueState("facts", "n long, first long, last long, timer long, closed boolean")

    def _leave(self, tx: int, status: str, first: int, last: int, held: list[tuple] | None = None) -> Iterator[Row]:
        """Rows of a transaction from the state, or those that came in one batch with its commit and were never in it."""
        n = 0
        # records of one batch are in order, and so are batches
        for pos, ts_ms, payload in self.data.get() if held is None else held:
            n += 1
            yield _OUT(tx, n, pos, ts_ms, payload, status, first, last)
        yield _OUT(tx, 0, None, None, None, status, first, last)
        if held is None:
            self.data.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # each call of the state is a message to the executor, so a transaction makes as few as it can
        n, first, last, timer, closed = self.facts.get() or (0, None, None, None, False)
        commit, waiting = False, []
        for r in sorted(rows, key=lambda r: (r["pos"], r["kind"] == "commit")):
            first, last = min(r["ts_ms"], r["ts_ms"] if first is None else first), max(r["ts_ms"], r["ts_ms"] if last is None else last)
            if r["kind"] == "data":
                if closed or commit:
                    yield _OUT(key[0], 0, r["pos"], r["ts_ms"], r["payload"], "late", first, last)
                else:
                    waiting.append((r["pos"], r["ts_ms"], r["payload"]))
            commit = commit or (r["kind"] == "commit" and not closed)
        whole = commit and n == 0
        if waiting and not whole:
            self.data.appendList(waiting)
        n += len(waiting)
        if commit:
            yield from self._leave(key[0], "complete", first, last, waiting if whole else None)
        due = max(last, timerValues.getCurrentWatermarkInMs()) + self.patience
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.facts.update((n, first, last, due, closed or commit))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, first, last, timer, closed = self.facts.get()
        if not closed:
            yield from self._leave(key[0], "unfinished", first, last)
        self.facts.clear()

    def close(self) -> None:
        pass


def assemble(records: DataFrame, delay: str = "1 minute", patience_ms: int = 3_600_000) -> DataFrame:
    """Rows of whole transactions (status complete), of those that stopped (unfinished) and of what came after a commit (late).

    records: tx, kind (begin, data, commit), pos, ts_ms and payload. Each transaction has a row with nth 0 and then its data,
    nth from 1, with the times of its first and last record. Splitting by status gives the two tables.
    """
    timed = records.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return timed.groupBy("tx").transformWithState(Assembler(patience_ms), OUT, "append", "EventTime")
