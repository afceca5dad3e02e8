"""Batches that stop between their steps and run again, and tables that stay held."""

import uuid

import duckdb
from pyspark.sql import functions as F

from tidelake.operators import apply as a
from tidelake.plans import ORACLES, QUERIES
from tidelake.sources.lake import LakeTable
from tidelake.streaming import jobs

from .conftest import rows_of, rows_of_sql

KEYS, DATA = ["k"], ["x"]
CHANGES = "topic string, part int, pos long, event_id string, op string, catalog_id long, k long, x long, ts_ms long"


def log(spark, tmp_path, *batches):
    """A stream that has one file for each batch, oldest first."""
    path = f"{tmp_path}/log-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame([("t", 0, p, i, op, c, k, x, p) for p, i, op, c, k, x in rows], CHANGES).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(path)


def table(spark, tmp_path):
    return LakeTable(spark, f"{tmp_path}/lake-{uuid.uuid4().hex}", KEYS, "k long, x long", buckets=2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stop_between_merge_and_ledger(spark, tmp_path, monkeypatch):
    """The first run stops after the merge; the second completes the ledger, so a later copy of the event is passed over."""
    lake, ledger, checkpoint = table(spark, tmp_path), f"{tmp_path}/ledger", f"{tmp_path}/checkpoint"
    first = [(1, "e1", "c", 1, 7, 10)]
    again = [(2, "e2", "u", 1, 7, 20), (3, "e1", "c", 1, 7, 10)]
    stream = log(spark, tmp_path, first, again)
    real = a.ledger_rows

    def stop(_):
        raise OSError("stopped")

    monkeypatch.setattr(a, "ledger_rows", stop)
    q = jobs.stream_apply(stream, lake, DATA, checkpoint, ledger)
    try:
        q.awaitTermination()
    except Exception as e:
        assert "stopped" in str(e)
    assert rows(lake.read()) == [(7, 10)] and lake.version() == 0 and not lake.exists(ledger)
    monkeypatch.setattr(a, "ledger_rows", real)
    jobs.stream_apply(stream, lake, DATA, checkpoint, ledger).awaitTermination()
    assert rows(lake.read()) == [(7, 20)]
    assert sorted(r[0] for r in spark.read.parquet(ledger).select("event_id").collect()) == ["e1", "e2"]


def test_held_tables_stay_held(spark, tmp_path):
    lake, held = table(spark, tmp_path), f"{tmp_path}/held"
    stream = log(spark, tmp_path, [(1, "a", "c", 1, 1, 1), (2, "b", "c", 2, 2, -1)], [(3, "c", "u", 2, 2, 5), (4, "d", "u", 1, 1, 2)])
    jobs.stream_quarantine(stream, lake, DATA, lambda b: b.where("x < 0"), held, f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(lake.read()) == [(1, 2)]
    assert sorted(r[0] for r in spark.read.parquet(held).select("event_id").collect()) == ["b", "c"]


def test_dedup_keeps_changes_under_one_id(spark):
    """Sent or delivered again: once. Another change under the same id: both, also in a later batch."""
    data = [("t", 0, 1, "f:4", "c", 1, 7, 1, 0), ("t", 0, 1, "f:4", "c", 1, 7, 1, 0), ("t", 0, 2, "f:4", "u", 1, 7, 2, 0), ("t", 0, 9, "f:4", "c", 1, 7, 1, 5)]
    changes = spark.createDataFrame(data, CHANGES)
    none = spark.createDataFrame([], jobs.LEDGER)
    assert sorted(r["pos"] for r in a.dedup(changes, none).collect()) == [1, 2]
    assert sorted(r["pos"] for r in a.dedup(changes, a.ledger_rows(changes.where("pos = 1"))).collect()) == [2]


def test_levels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"t{i:02}", f"t{i - 1:02}") for i in range(1, 40)] + [("a", "b"), ("b", "a"), ("t00", "t00")], "child string, parent string")
    tables = spark.createDataFrame([(f"t{i:02}",) for i in range(40)] + [("a",), ("b",)], "name string")
    assert {r[0]: r[1] for r in a.table_levels(tables, edges).collect()} == {f"t{i:02}": i for i in range(40)} | {"a": None, "b": None}


def test_bucket_number_follows_the_first_batch(spark, tmp_path, monkeypatch):
    from tidelake.sources import lake

    monkeypatch.setattr(lake, "BUCKET_ROWS", 10)
    t = LakeTable(spark, f"{tmp_path}/sized", KEYS, "k long, x long")
    batch = spark.range(400).select(F.lit(0).alias("part"), F.col("id").alias("pos"), F.lit("c").alias("op"), F.col("id").alias("k"), F.lit(1).cast("long").alias("x"))
    assert t.merge(batch, DATA, 0) and not t.merge(batch, DATA, 0)
    assert t.manifest()[1] == 40 and t.read().count() == 400


def test_release_beyond_ten_million_positions(spark, tmp_path):
    """Copies of messages lie 10,000,000 positions on; beyond that a position is a copy's or a first message's."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT 6007 * e AS event_id, TIMESTAMP '2024-01-01' + to_seconds(e) AS ts, e % 45 AS user_id, ['view', 'signup', 'error', 'click'][1 + e % 4] AS event_type, e / 8 AS value, '{{}}' AS props FROM range(3000) r(e)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = rows_of(QUERIES["stream_release"](spark, str(tmp_path)))
    assert got == rows_of_sql(duck, ORACLES["stream_release"])
    assert got[1]
