"""A lake table against a dictionary: batches, splits, folds, schema growth, and what a batch writes."""

import os
import random
import uuid

from pyspark.sql import functions as F

from tidelake.sources import lake
from tidelake.sources.lake import LakeTable

KEYS, DATA = ["k"], ["x"]
CHANGES = "part int, pos long, op string, k long, x long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def written(path, version):
    """Bytes of Parquet files that a version has written."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/data/v{version}") for f in fs if f.endswith(".parquet"))


def test_batches_splits_and_folds(spark, tmp_path, monkeypatch):
    """Buckets split one at a time, deletes stay deleted through folds, and a replayed version does nothing."""
    monkeypatch.setattr(lake, "BUCKET_ROWS", 40)
    t, want, rng = LakeTable(spark, f"{tmp_path}/t", KEYS, "k long, x long", buckets=2), {}, random.Random(1)
    sizes = []
    for v in range(24):
        batch = []
        for p in range(30):
            k, op = rng.randrange(60 + 20 * v), rng.choice("ccud")
            batch.append((0, v * 100 + p, op, k, p))
            want.pop(k, None) if op == "d" else want.__setitem__(k, p)
        d = spark.createDataFrame(batch, CHANGES)
        assert t.merge(d, DATA, v)
        sizes.append(t.state().buckets)
        if v % 6 == 5:
            assert not t.merge(d, DATA, v) and rows(t.read()) == sorted(want.items())
    assert sizes[0] == 2 and sizes[-1] > 4 and all(0 <= b - a <= 4 for a, b in zip(sizes, sizes[1:], strict=False))
    s = t.state()
    # each row lies in the bucket that its key tells
    for b in s.parts:
        assert {r[0] for r in t.read([b]).select(t.bucket(s.buckets, s.first)).distinct().collect()} <= {b}
    assert max(len(p) for p in s.parts.values()) <= lake.TURN + 8
    assert t.vacuum() > 0 and rows(t.read()) == sorted(want.items())
    assert len([n for n in os.listdir(f"{tmp_path}/t/manifests") if n.endswith(".json")]) == lake.KEPT


def test_written_bytes_stay_near_constant(spark, tmp_path, monkeypatch):
    """A hundred batches of a thousand rows into an empty table."""
    monkeypatch.setattr(lake, "BUCKET_ROWS", 8000)
    t = LakeTable(spark, f"{tmp_path}/t", KEYS, "k long, x long", buckets=4)
    sizes = []
    for v in range(100):
        ids = F.col("id") + v * 1000
        batch = spark.range(0, 1000, 1, 2).select(F.lit(0).alias("part"), ids.alias("pos"), F.lit("c").alias("op"), ids.alias("k"), (ids * 7 % 1000).alias("x"))
        t.merge(batch, DATA, v)
        sizes.append(written(f"{tmp_path}/t", v))
    assert t.read().count() == 100_000 and t.state().buckets > 8
    early, late = sum(sizes[20:40]), sum(sizes[80:])
    assert late < 2 * early, (early, late)
    assert late / 20 < 12 * sizes[0]


def test_schema_grows(spark, tmp_path):
    """The third batch brings a column and a value of 64 bits; buckets that it doesn't touch are not written."""
    t = LakeTable(spark, f"{tmp_path}/t", KEYS, "k long, x int", buckets=16)
    d = lambda rows, more="": spark.createDataFrame(rows, "part int, pos long, op string, k long, x int" + more)
    t.merge(d([(0, i, "c", i, i) for i in range(100)]), DATA, 0)
    t.merge(d([(0, 200, "u", 7, 70), (0, 201, "d", 8, None)]), DATA, 1)
    before = t.state()
    wide = spark.createDataFrame([(0, 300, "u", 9, 2**40, "new"), (0, 301, "c", 500, 1, None)], "part int, pos long, op string, k long, x long, note string")
    t.merge(wide, ["x", "note"], 3)
    after = t.state()
    assert after.schema.simpleString() == "struct<k:bigint,x:bigint,note:string>"
    want = {i: (i, None) for i in range(100)} | {7: (70, None), 9: (2**40, "new"), 500: (1, None)}
    want.pop(8)
    assert {r["k"]: (r["x"], r["note"]) for r in t.read().collect()} == want
    moved = [b for b in before.parts if before.parts[b][0] not in after.parts[b]]
    assert len(moved) <= 2
    # a later batch without the column leaves it null in what it writes
    t.merge(d([(0, 400, "u", 9, 1)]), DATA, 4)
    assert {r["k"]: (r["x"], r["note"]) for r in t.read().where("k = 9").collect()} == {9: (1, None)}


def test_failed_merge_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = LakeTable(spark, f"{tmp_path}/{uuid.uuid4().hex}", KEYS, "k long, x long", buckets=2)
    d = spark.createDataFrame([(0, 1, "c", 1, 1)], CHANGES)
    t.merge(d, DATA, 0)
    real = LakeTable._publish
    monkeypatch.setattr(LakeTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    try:
        t.merge(spark.createDataFrame([(0, 2, "u", 1, 2)], CHANGES), DATA, 1)
    except OSError:
        pass
    monkeypatch.setattr(LakeTable, "_publish", real)
    assert rows(t.read()) == [(1, 1)]
    # nor does a manifest that was not written to its end
    with open(f"{tmp_path}/half", "w") as f:
        f.write('{"version": 1, "buc')
    fs, p = t._fs(f"{t.path}/manifests/v{1:012d}.json")
    fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/half"), p)
    assert t.version() == 0
    assert t.merge(spark.createDataFrame([(0, 2, "u", 1, 2)], CHANGES), DATA, 1) and rows(t.read()) == [(1, 2)]


def test_a_batch_is_reduced_once(spark, tmp_path, monkeypatch):
    """Rows and deleted keys of a batch come from one pass over it."""
    t = LakeTable(spark, f"{tmp_path}/once", ["k"], "k long, x long", buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, x long, op string, part int, pos long")
    t.merge(rows((1, 1, "c", 0, 1), (2, 2, "c", 0, 2), (3, 3, "c", 0, 3)), ["x"], 0)
    write, plans = t._write, []

    def watched(found, *more):
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
        return write(found, *more)

    monkeypatch.setattr(t, "_write", watched)
    t.merge(rows((1, 9, "u", 0, 4), (1, None, "d", 0, 5), (2, None, "d", 0, 6), (2, 7, "c", 0, 7), (4, None, "u", 0, 8), (None, 1, "c", 0, 9), (3, 5, None, 0, 10)), ["x"], 1)
    assert plans[0].count("Aggregate") == 1
    assert sorted(map(tuple, t.read().collect())) == [(2, 7), (3, 3), (4, None)]
