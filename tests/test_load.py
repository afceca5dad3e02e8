"""Slice plans against brute force: open ends, gaps, null keys, an empty plan, and keys of two columns."""

from pyspark.sql import functions as F

from tidelake.operators import load as ld


def test_assign_by_halves(spark):
    bounds = [None, 3, 7, 20, 21, 40]
    plan = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:] + [None], strict=True)) if i != 2]  # a gap
    keys = list(range(-5, 60)) + [7, 7]
    slices = spark.createDataFrame(plan, "slice int, b int, e int").select("slice", *[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("k"))).alias(n) for c, n in (("b", "begin"), ("e", "end"))])
    rows = spark.createDataFrame([(k,) for k in keys], "k int").repartition(3)
    got = sorted(tuple(r) for r in ld.assign(rows, slices, ["k"]).collect())
    want = sorted((k, i) for k in keys for i, lo, hi in plan if (lo is None or k >= lo) and (hi is None or k < hi))
    assert got == want
    assert ld.assign(rows, slices.limit(0), ["k"]).count() == 0
    assert ld.assign(rows.limit(0), slices, ["k"]).count() == 0


def test_assign_two_columns(spark):
    rows = spark.createDataFrame([(a, b) for a in range(6) for b in "xyz"], "a int, b string")
    edges = spark.createDataFrame([(1, "y"), (3, "x"), (3, "z")], "a int, b string")
    got = {(r.a, r.b): r.slice for r in ld.assign(rows, ld.slice_bounds(edges, ["a", "b"]), ["a", "b"]).collect()}
    assert got == {(a, b): sum((a, b) >= e for e in [(1, "y"), (3, "x"), (3, "z")]) for a in range(6) for b in "xyz"}


def test_resume_after_last_key(spark):
    rows = spark.createDataFrame([(k,) for k in [None, *range(30)]], "k long")
    slices = ld.int_slices(rows, "k", 3)
    catalog = spark.createDataFrame([(0, 4), (1, 12)], "slice int, last_key long")
    lake = spark.createDataFrame([(1, 15)], "slice int, last_key long")
    got = sorted(tuple(r) for r in ld.resume(rows, slices, "k", catalog, lake).collect())
    assert got == [(k, k // 10) for k in range(30) if k > {0: 4, 1: 15, 2: -1}[k // 10]]
    assert ld.resume(rows, slices.limit(0), "k", catalog, lake).count() == 0


def test_keys_at_offsets_by_narrowing(spark, monkeypatch):
    """Against a sort: several rounds, heavy ties, two columns, nulls."""
    import random

    monkeypatch.setattr(ld, "FEW_ROWS", 40)
    monkeypatch.setattr(ld, "CUTS", 8)
    rng = random.Random(3)
    for make in (lambda i: (i, "a"), lambda i: (min(i, 700) if i % 2 else 500, "b"), lambda i: (rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]))):
        keys = [make(i) for i in range(3000)]
        rng.shuffle(keys)
        got = ld.sampled_boundaries(spark.createDataFrame(keys, "a long, b string").repartition(3), ["a", "b"], 7).collect()
        whole = sorted(keys, key=lambda k: [(x is not None, x) for x in k])
        assert [tuple(r) for r in got] == [(*whole[3000 * i // 7], 3000 * i // 7) for i in range(1, 7)]
    few = spark.createDataFrame([(1, "a")], "a long, b string")
    assert ld.sampled_boundaries(few, ["a", "b"], 4).count() == 0 and ld.sampled_boundaries(few.limit(0), ["a"], 4).columns == ["a", "at"]


def test_copy_goes_on_after_any_slice(spark, tmp_path):
    """Stopped after each slice in turn, also in the middle of one: later runs write only the others, and no row twice."""
    rows = spark.createDataFrame([(k, k * 2) for k in range(60)], "k long, x long").repartition(2)
    plan = ld.slice_bounds(spark.createDataFrame([(10,), (25,), (26,), (50,), (90,)], "k long"), ["k"])
    seen = []

    def stop(slice_):
        seen.append(slice_)
        raise OSError("stopped")

    path = f"{tmp_path}/copy"
    for _ in range(3):
        try:
            ld.copy_slices(rows, plan, ["k"], path, at_once=2, after=stop)
        except OSError:
            pass
        # what a run leaves that stopped while it wrote a slice
        rows.where("k >= 50").limit(3).write.mode("append").parquet(f"{path}/data/_slice=4") if len(seen) == 1 else None
    assert seen == [1, 3, 5]
    got = ld.copy_slices(rows, plan, ["k"], path, after=stop)
    assert sorted(tuple(r) for r in got.collect()) == [(k, k * 2) for k in range(60)] and len(seen) == 3
    assert {r["slice"]: r["rows"] for r in spark.read.parquet(f"{path}/checkpoints").select("slice", "rows").collect()} == {0: 10, 1: 15, 2: 1, 3: 24, 4: 10, 5: 0}
    assert ld.copy_slices(rows.limit(0), plan, ["k"], f"{tmp_path}/none").count() == 0


def test_rows_dont_carry_the_plan(spark):
    """A plan of 20,000 slices is no column of the rows, which a row would pay for by its size."""
    plan = ld.slice_bounds(spark.range(0, 200_000, 10).select(F.col("id").alias("k")), ["k"])
    found = ld.assign(spark.range(200_000).withColumnRenamed("id", "k"), plan, ["k"])
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("slice <> k div 10 + 1").count() == 0 and found.count() == 200_000


def test_copy_of_many_slices_takes_few_jobs(spark, tmp_path):
    """However many slices there are; a run that stopped goes on, and null keys lie in the open begin."""
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("x")).repartition(2)
    plan = ld.slice_bounds(spark.range(7, 3000, 3).select(F.col("id").alias("k")), ["k"])
    ends = []

    def stop(slice_):
        ends.append(slice_)
        if len(ends) == 2:
            raise OSError("stopped")

    try:
        ld.copy_slices(rows, plan, ["k"], f"{tmp_path}/copy", at_once=2, after=stop)
    except OSError:
        pass
    got = ld.copy_slices(rows, plan, ["k"], f"{tmp_path}/copy", at_once=2, after=stop)
    assert len(ends) <= 2 + 16 and ends[-1] == 998
    assert sorted(got.collect(), key=lambda r: r.x) == sorted(rows.collect(), key=lambda r: r.x)
    assert {r["slice"]: r["rows"] for r in spark.read.parquet(f"{tmp_path}/copy/checkpoints").collect()} == {0: 7, **{i: 3 for i in range(1, 998)}, 998: 2}
