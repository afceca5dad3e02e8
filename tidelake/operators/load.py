"""Snapshot loads in key slices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def int_slices(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n half-open slices of equal width over an integer key's range; the last takes the rest."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo is not null")
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / n), F.lit(1))
    return ends.select("lo", "hi", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice")).select("slice", (F.col("lo") + F.col("slice") * F.col("w")).alias("begin"), F.when(F.col("slice") == n - 1, F.col("hi") + 1).otherwise(F.col("lo") + (F.col("slice") + 1) * F.col("w")).alias("end"))


#: Keys of a sample that cut a range, and rows of ranges that are few enough for one sort.
CUTS, FEW_ROWS = 512, 200_000


def _classes(rows: DataFrame, cuts: list) -> DataFrame:
    """Add `c` to rows with `k`: 2 i + 1 for the i-th of the sorted cuts (from 0), 2 i for what lies in front of it."""
    plan = rows.sparkSession.createDataFrame([(cuts,)], T.StructType([T.StructField("_cuts", T.ArrayType(rows.schema["k"].dataType))]))  # one row
    halves = F.lit([1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)])
    cut = lambda i: F.get("_cuts", i - 1)
    below = F.aggregate(halves, F.lit(0), lambda at, half: F.when((at + half <= len(cuts)) & (cut(at + half) <= F.col("k")), at + half).otherwise(at))
    found = rows.crossJoin(F.broadcast(plan)).select("k", F.explode(F.array(below)).alias("_n"), "_cuts")
    return found.select("k", (F.col("_n") * 2 - F.when((F.col("_n") > 0) & (cut(F.col("_n")) == F.col("k")), 1).otherwise(0)).alias("c"))


def keys_at(rows: DataFrame, size: int, offsets: list[int]) -> dict[int, Row]:
    """The keys (column k) at some offsets of the key order, exactly and without sorting or moving the rows.

    A sample's keys cut the order into ranges. Counting rows by range tells which ranges hold an offset, and only their
    rows are looked at again, with the offsets counted among them, until they are few enough for one sort. A key that many
    rows share becomes a cut of its own.
    """
    found: dict[int, Row] = {}
    places = {x: [x] for x in offsets}  # offset among the rows that are left: offsets asked for
    turn = 0
    while places and size > FEW_ROWS:
        sample = rows.where(F.rand(turn) < min(1.0, 2 * CUTS / size)).distinct().agg(F.sort_array(F.collect_list("k")).alias("k"))
        cuts = sample.first()["k"]  # some CUTS keys
        turn += 1
        if not cuts:
            continue
        classed = _classes(rows, cuts)
        counts = {r["c"]: r["n"] for r in classed.groupBy("c").agg(F.count("*").alias("n")).collect()}
        start, kept, next_places = 0, 0, {}
        keep: list[int] = []
        for c in sorted(counts):
            inside = [x for x in places if start <= x < start + counts[c]]
            if inside and c % 2:
                found |= {offset: cuts[c // 2] for x in inside for offset in places[x]}
            elif inside:
                keep.append(c)
                next_places |= {kept + x - start: places[x] for x in inside}
                kept += counts[c]
            start += counts[c]
        rows, size, places = classed.where(F.col("c").isin(keep)).select("k"), kept, next_places
    if places:
        nth = F.row_number().over(Window.orderBy("k")) - 1  # FEW_ROWS rows at most
        for r in rows.withColumn("n", nth).where(F.col("n").isin(list(places))).collect():
            found |= {offset: r["k"] for offset in places[r["n"]]}
    return found


def sampled_boundaries(rows: DataFrame, keys: list[str], workers: int, least: int = 2) -> DataFrame:
    """Keys at the offsets n * i / workers of the key order, which split the rows evenly whatever the keys are like."""
    spark, picked = rows.sparkSession, rows.select(F.struct(*keys).alias("k"))
    schema = T.StructType([*[f for f in rows.select(*keys).schema.fields], T.StructField("at", T.LongType())])
    n = rows.count()
    if n < least or workers < 2:
        return spark.createDataFrame([], schema)
    found = keys_at(picked, n, sorted({n * i // workers for i in range(1, workers)} - {0}))
    return spark.createDataFrame([(*k, at) for at, k in sorted(found.items())], schema)


#: Jobs of a copy at most; a plan of many slices gives each job more of them.
MOST_JOBS = 16


def copy_slices(rows: DataFrame, slices: DataFrame, keys: list[str], path: str, at_once: int = 8, after: Callable[[int], None] | None = None) -> DataFrame:
    """Copy rows slice by slice into path, and return the copy; a run that stopped is gone on with.

    slices: slice, begin and end as structs of the keys (null: open). A job writes a run of slices, at_once of them or, of
    a plan with more than 16 times as many, a sixteenth, to a folder of its own, and then their checkpoint rows (slice, rows). What
    has a checkpoint is not read again; what a stopped run left without one is written anew, so no row comes twice. The
    runs' bounds reach the scan, so the number of jobs and of scans doesn't grow with the plan. Null keys lie in an open begin.
    """
    spark, checkpoints, data = rows.sparkSession, f"{path}/checkpoints", f"{path}/data"
    done = {r["slice"] for r in _checkpoints(spark, path).collect()}
    plan = [r for r in slices.select("slice", "begin", "end").orderBy("begin").collect() if r["slice"] not in done]  # a row for each slice
    columns = [F.col(k) for k in keys]
    size = max(at_once, -(-len(plan) // MOST_JOBS))
    for at in range(0, len(plan), size):
        group = plan[at : at + size]
        low, high = group[0]["begin"], group[-1]["end"]
        bounds = [tuple_compare(columns, list(x), op) for x, op in ((low, "ge"), (high, "lt")) if x is not None]
        near = reduce(lambda x, y: x | y, [c.isNull() for c in columns], reduce(lambda x, y: x & y, bounds, F.lit(True)))
        own = spark.createDataFrame(group, slices.select("slice", "begin", "end").schema).withColumnRenamed("slice", "_number")
        folder = f"{data}/group={group[0]['slice']}"
        assign(rows.where(near), own, keys).write.mode("overwrite").parquet(folder)
        sizes = spark.read.schema("_number int").parquet(folder).groupBy("_number").agg(F.count("*").alias("rows"))
        counted = own.select("_number").join(sizes, "_number", "left").select(F.col("_number").cast("int").alias("slice"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        counted.coalesce(1).write.mode("overwrite").parquet(f"{checkpoints}/group={group[0]['slice']}")  # a row for each slice
        if after:
            after(group[-1]["slice"])
    folders = [f"{data}/group={r['group']}" for r in _checkpoints(spark, path).where("rows > 0").select("group").distinct().collect()]
    return spark.read.schema(rows.schema).parquet(*folders) if folders else spark.createDataFrame([], rows.schema)


CHECKPOINT = "slice int, rows long, group int"


def _checkpoints(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoints")
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CHECKPOINT).parquet(f"{path}/checkpoints") if there else spark.createDataFrame([], CHECKPOINT)


def slice_bounds(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Slices between boundaries, equal ones once, both ends open: slice, begin and end as structs of the keys."""
    b = boundaries.select(F.struct(*keys).alias("k")).distinct()
    w = Window.orderBy("k")  # as many rows as there are slices
    inner = b.select(F.row_number().over(w).alias("slice"), F.col("k").alias("begin"), F.lead("k").over(w).alias("end"))
    first = b.agg(F.min("k").alias("end")).select(F.lit(0).alias("slice"), F.lit(None).cast(b.schema["k"].dataType).alias("begin"), "end")
    return first.unionByName(inner)


def tuple_compare(columns: list[Column], values: list, op: str) -> Column:
    """(columns) op (values) by lexical order, op one of gt, ge, lt, le, as a chain of ANDs and ORs that sources can
    push down; with fewer values the columns' prefix is compared."""
    n = min(len(columns), len(values))
    strict = (lambda c, v: c > v) if op[0] == "g" else (lambda c, v: c < v)
    terms = []
    for i in range(n):
        parts = [columns[j] == values[j] for j in range(i)] + [strict(columns[i], values[i])]
        terms.append(reduce(lambda a, b: a & b, parts))
    if op[1] == "e":
        terms.append(reduce(lambda a, b: a & b, [columns[j] == values[j] for j in range(n)]))
    return reduce(lambda a, b: a | b, terms)


def _within(rows: DataFrame, slices: DataFrame, k: Column) -> DataFrame:
    """rows with `_slice`, the struct of the half-open slice that k lies in; rows outside all slices are dropped.

    The plan, a row per slice, is one sorted array that each row searches by halves, so a row costs as many comparisons as
    the number of slices has bits. The array is a scalar subquery: a column that rows carry would be copied for each row.
    """
    rest = [c for c in slices.columns if c not in ("begin", "end")]
    plan = slices.agg(F.sort_array(F.collect_list(F.struct("begin", "end", *rest))).alias("_plan"))  # one row; an open begin comes first
    n = F.size("p")
    halves = F.when(n > 0, F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int")))
    whole = plan.select(F.col("_plan").alias("p")).select(F.struct("p", halves.alias("halves"), n.alias("n"))).scalar()

    def search(w: Column) -> Column:
        begins = lambda i: F.get(w["p"], i - 1)["begin"]
        starts = lambda i: (i <= w["n"]) & (begins(i).isNull() | (begins(i) <= k))
        last = F.aggregate(w["halves"], F.lit(0), lambda at, half: F.when(starts(at + half), at + half).otherwise(at))
        return F.get(F.transform(F.array(last), lambda i: F.when(i > 0, F.get(w["p"], i - 1))), F.lit(0))

    # the subquery's column is used once, so it is no column of rows but a value beside them; of an inner explode Spark would
    # infer a filter, which searches again
    here = F.get(F.transform(F.array("_whole"), search), F.lit(0))
    found = F.filter(F.array(here), lambda x: x.isNotNull() & (x["end"].isNull() | (k < x["end"])))
    return rows.withColumn("_whole", whole).select(*rows.columns, found.alias("_found")).select(*rows.columns, F.explode_outer("_found").alias("_slice")).where("_slice is not null")


def assign(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's slice by a plan of slices that don't overlap; rows outside the plan are dropped."""
    rest = [F.col(f"_slice.{c}") for c in slices.columns if c not in ("begin", "end")]
    return _within(rows, slices, F.struct(*keys)).select(*rows.columns, *rest)


def contiguous(slices: DataFrame) -> DataFrame:
    """Whether a plan has neither gaps nor overlaps: one row, contiguous and slices."""
    w = Window.orderBy("slice")  # as many rows as there are slices
    rows = slices.withColumn("_before", F.lag("end").over(w))
    ok = F.col("begin").eqNullSafe(F.col("_before"))
    return rows.agg(F.every(ok).alias("contiguous"), F.count("*").alias("slices"))


def resume(rows: DataFrame, slices: DataFrame, key: str, catalog_side: DataFrame, lake_side: DataFrame) -> DataFrame:
    """Rows still to copy of an integer-keyed plan: each slice strictly after its last key; the lake's own place wins."""
    last = catalog_side.withColumnRenamed("last_key", "a").join(lake_side.withColumnRenamed("last_key", "b"), "slice", "full").select("slice", F.coalesce("b", "a").alias("last_key"))
    plan = slices.select("begin", "end", "slice").join(last, "slice", "left").where("begin is not null and end is not null")
    found = _within(rows, plan, F.col(key))
    return found.where(F.col("_slice.last_key").isNull() | (F.col(key) > F.col("_slice.last_key"))).select(*rows.columns, F.col("_slice.slice").alias("slice"))


def merge_incremental(mirror: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with their keys; nothing is truncated."""
    return mirror.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def same_rows(want: Column, have: Column) -> Column:
    """Whether a count is as expected: exactly up to ten million rows, then within 0.01 %; an unknown count (below 0) is."""
    return (want < 0) | (have < 0) | (want == have) | ((want > 10_000_000) & (F.abs(want - have) <= want * 0.0001))


def verify(counts: DataFrame) -> DataFrame:
    """Row-count verdict of loads: catalog_id, mode, ok, message, diff and pending_gap (changes still to come).

    counts: source_rows (now, -1 if unknown), lake_rows, baseline_rows (when the load began, null without one), rows_loaded
    (0 if not told) and reconciles (whether changes of the load's time reach the lake). A load that reconciles is held
    against its baseline from below and against the live source, else the baseline, from above: a lake more than 5 % larger
    was loaded twice. Another load must equal its baseline, or without one the source, by what it loaded, and what it loaded
    must be in the lake. A lake with more rows than were loaded was resumed.
    """
    live, lake, base = F.coalesce("source_rows", F.lit(-1)), F.coalesce("lake_rows", F.lit(-1)), F.col("baseline_rows")
    loaded = F.coalesce("rows_loaded", F.lit(0))
    based, streaming = base.isNotNull(), base.isNotNull() & F.coalesce("reconciles", F.lit(False))
    told = loaded > 0
    resumed = told & (lake > loaded)
    above = lambda want: (want > 0) & (lake >= 0) & (lake > want) & ((lake - want) / want > 0.05)
    known = (base >= 0) & (lake >= 0)
    copied = F.when(told, loaded).otherwise(lake)
    message = (
        F.when(streaming, F.when(~known, "ok").when((lake < base) & ~same_rows(base, lake), "incomplete_copy").when((live >= 0) & above(live), "duplicate_load").when((live < 0) & above(base), "duplicate_load").otherwise("ok"))
        .when(based, F.when(same_rows(base, lake), "ok").otherwise("row_mismatch"))
        .when(~same_rows(live, copied), "row_mismatch")
        .when(told & (lake >= 0) & ~same_rows(lake, loaded), "lake_mismatch")
        .otherwise("ok")
    )
    ok = message == "ok"
    mode = F.when(streaming, F.when(ok & known & resumed, "baseline_snapshot_streaming_resumed").otherwise("baseline_snapshot_streaming")).when(based, F.when(ok & resumed, "baseline_snapshot_resumed").otherwise("baseline_snapshot")).otherwise("live_source")
    diff = (
        F.when(streaming, F.when(~known, 0).when(message == "duplicate_load", lake - F.when(live >= 0, live).otherwise(base)).otherwise(base - lake))
        .when(based, base - lake)
        .when(message == "lake_mismatch", lake - loaded)
        .otherwise(live - copied)
    )
    gap = F.when(streaming & ok & known & (live >= 0), live - lake)
    return counts.select("catalog_id", mode.alias("mode"), ok.alias("ok"), message.alias("message"), diff.cast("long").alias("diff"), gap.cast("long").alias("pending_gap"))


def baseline(checkpoints: DataFrame) -> DataFrame:
    """Source rows that a load is measured by: its first truncate checkpoint's, else copy's, else ddl's."""
    rank = F.when(F.col("phase") == "truncate", 0).when(F.col("phase") == "copy", 1).otherwise(2)
    return checkpoints.groupBy("catalog_id").agg(F.min_by("source_rows", F.struct(rank, "worker_id")).alias("baseline_rows"))


def window_replay(snapshot: DataFrame, changes: DataFrame, bookmarks: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """A mirror from a snapshot and the changes since it began: those at or above each partition's bookmark."""
    from .apply import apply_batch

    late = changes.join(F.broadcast(bookmarks), ["topic", "part"]).where(F.col("pos") >= F.col("bookmark")).drop("bookmark")
    return apply_batch(snapshot, late, keys, data)


def load_action(catalog: DataFrame) -> DataFrame:
    """What a load does by the table's mode."""
    m = F.col("snapshot_mode")
    return catalog.select("catalog_id", F.when(m == "never", "skip").when(m == "schema_only", "create").when(m == "incremental", "merge").otherwise("truncate_copy").alias("action"))


def copy_rows(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, how many were skipped for an empty key)."""
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return rows.where(~bad), rows.agg(F.count_if(bad).alias("skipped"), F.count_if(~bad).alias("copied"))
