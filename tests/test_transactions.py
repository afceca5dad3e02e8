"""Transactions across batches, stopped ones that leave by timer, and what is left in the state."""

import uuid

from tidelake.streaming.transactions import assemble, rocksdb

RECORD = "tx long, kind string, pos long, ts_ms long, payload string"


def test_transactions_across_batches(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out-{uuid.uuid4().hex}"
    batches = [
        [(1, "begin", 1, 1000, None), (1, "data", 2, 1010, "a"), (2, "begin", 3, 1020, None), (2, "data", 4, 1030, "x"), (3, "data", 5, 1040, "p")],
        [(1, "data", 7, 1060, "c"), (1, "data", 6, 1050, "b"), (2, "data", 8, 1070, "y"), (3, "commit", 9, 1080, None)],
        [(1, "commit", 10, 1090, None), (3, "data", 11, 1100, "q")],
        [(9, "begin", 12, 10_000_000, None)],
        [(9, "data", 13, 10_000_001, "z")],
    ]
    for b in batches:
        spark.createDataFrame(b, RECORD).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(path)
    with rocksdb(spark):
        q = assemble(stream, "1 second", 60_000).writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").format("parquet").trigger(availableNow=True).start(out)
        q.awaitTermination()
    rows = [tuple(r) for r in spark.read.parquet(out).collect()]
    data = lambda status: sorted((r[0], r[1], r[4]) for r in rows if r[5] == status and r[4])
    assert data("complete") == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (3, 1, "p")]
    assert data("unfinished") == [(2, 1, "x"), (2, 2, "y")]
    assert data("late") == [(3, 0, "q")]
    assert {(r[0], r[6], r[7]) for r in rows if r[1] == 0 and r[5] != "late"} == {(1, 1000, 1090), (2, 1020, 1070), (3, 1040, 1080)}
    # only the open transaction is left
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_whole_transaction_of_one_batch_is_not_kept():
    """Begin, data and commit in one batch leave in order without a call of the list state."""
    from types import SimpleNamespace
    from unittest.mock import Mock

    from pyspark.sql import Row

    from tidelake.streaming.transactions import Assembler

    a = Assembler(1000)
    a.handle, a.data, a.facts = Mock(), Mock(), Mock()
    a.facts.get.return_value = None
    record = Row("kind", "pos", "ts_ms", "payload")
    rows = [record("commit", 4, 40, None), record("data", 3, 30, "b"), record("begin", 1, 10, None), record("data", 2, 20, "a"), record("data", 5, 50, "late")]
    got = [tuple(r) for r in a.handleInputRows((7,), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))]
    assert got[1:] == [(7, 1, 2, 20, "a", "complete", 10, 50), (7, 2, 3, 30, "b", "complete", 10, 50), (7, 0, None, None, None, "complete", 10, 50)]
    assert got[0][3:6] == (50, "late", "late")
    assert not a.data.method_calls and not a.facts.exists.called
    a.facts.update.assert_called_once_with((2, 10, 50, 1050, True))
