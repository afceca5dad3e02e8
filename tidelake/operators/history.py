"""Type 2 history beside a mirror.

A version has the key, its data, valid_from, valid_to (null while open), is_current and is_deleted. A key's changes are
laid out in order of time; of equal times the order columns decide, and nulls come first.

A key with more than HOT_ROWS rows is laid out in slices of time, each a task of its own: what a slice needs of its
neighbours is one row, the last state before it or the next change behind it, and those rows, one for each key and slice,
are carried over by a window of their own. Rows of one instant are never parted, and null keys are not sliced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import estimated_bytes, materialize

#: Rows of a key beyond which it is sliced, and what input (as Spark estimates it) may be laid out without a look at its keys.
HOT_ROWS, PLAIN_BYTES = 1_000_000, 32 << 20
#: The most slices of a key, and the most bounds of slices that are broadcast.
MOST_SLICES, BROADCAST_BOUNDS = 10_000, 1_000_000
#: Columns of rows in slices: the slice's number in its key, and whether the key has any.
SLICE, HOT = "_slice", "_hot"


def sliced(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """rows with SLICE and HOT, if a key has more than HOT_ROWS rows; else as they are.

    Bounds are percentiles of a hot key's times, from sketches that tasks merge, so no task sees a key whole.
    """
    if estimated_bytes(rows) <= PLAIN_BYTES:
        return rows
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(*keys, "_n"), "hot_keys")
    seen = hot.agg(F.max("_n").alias("most"), F.count("*").alias("keys")).first()
    if not seen["keys"]:
        return rows
    n = max(2, min(MOST_SLICES, -(-seen["most"] // HOT_ROWS)))
    few = lambda df: F.broadcast(df) if seen["keys"] * n <= BROADCAST_BOUNDS else df
    own = rows.select(*keys, F.col(time).alias("_t")).join(few(hot.select(*keys)), keys, "left_semi")
    cut = F.percentile_approx("_t", [i / n for i in range(1, n)], 10 * n)
    bounds = own.groupBy(*keys).agg(cut.alias("_bounds"))
    bounds = few(materialize(bounds.withColumn("_bounds", F.array_sort(F.array_distinct("_bounds"))), "hot_bounds"))
    halves = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    inside = lambda at: (at <= F.size("_bounds")) & F.coalesce(F.get("_bounds", at - 1) <= F.col(time), F.lit(False))
    number = F.aggregate(halves, F.lit(0), lambda at, half: F.when(inside(at + half), at + half).otherwise(at))
    placed = rows.join(bounds, keys, "left").withColumn(HOT, F.col("_bounds").isNotNull())
    return placed.withColumn(SLICE, F.when(F.col(HOT), number).otherwise(0)).select(*rows.columns, SLICE, HOT)


def _over(rows: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, SLICE] if SLICE in rows.columns else keys


def beside(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """rows with the value of the row before (ahead: behind) in their key's order as `name`, null at the end; the value is never null."""
    over, step = _over(rows, keys), F.lead if ahead else F.lag
    near = step(value).over(Window.partitionBy(*over).orderBy(*order))
    if over == keys:
        return rows.withColumn(name, near)
    edge = (F.min_by if ahead else F.max_by)(value, F.struct(*order))
    edges = rows.where(HOT).groupBy(*over).agg(edge.alias("_edge"))
    carried = edges.select(*over, step("_edge").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_carried"))  # a row for each slice
    return rows.join(carried, over, "left").withColumn(name, F.coalesce(near, "_carried")).select(*rows.columns, name)


def staged(changes: DataFrame, keys: list[str], data: list[str], time: str = "ts_ms", order: tuple[str, ...] = ("part", "pos")) -> DataFrame:
    """Rows to lay out: keys, data (null in deletes), valid_from, deleted and the order columns."""
    gone = F.col("op") == "d"
    return changes.select(*keys, *[F.when(~gone, F.col(c)).alias(c) for c in data], F.col(time).alias("valid_from"), gone.alias("deleted"), *order)


def steps(rows: DataFrame, keys: list[str], data: list[str], order: tuple[str, ...] = ("part", "pos")) -> DataFrame:
    """The rows that change something, deletes among them, with _next (valid_from, deleted), the key's next step."""
    now, place = F.struct(*data, "deleted"), ["valid_from", *order]
    seen = beside(sliced(rows, keys, "valid_from"), keys, place, now, "_before")
    kept = seen.where(~now.eqNullSafe(F.col("_before"))).drop("_before")
    return beside(kept, keys, place, F.struct("valid_from", "deleted"), "_next", ahead=True).select(*rows.columns, "_next")


def versions(laid: DataFrame, keys: list[str], data: list[str], *more: str) -> DataFrame:
    """Steps as versions: each ends at the next step; a delete makes none but marks the one that it ends."""
    following = F.col("_next")
    return laid.where(~F.col("deleted")).select(*keys, *more, *data, "valid_from", following["valid_from"].alias("valid_to"), following.isNull().alias("is_current"), F.coalesce(following["deleted"], F.lit(False)).alias("is_deleted"))


def record(changes: DataFrame, keys: list[str], data: list[str], time: str = "ts_ms", order: tuple[str, ...] = ("part", "pos")) -> DataFrame:
    """History of a change log: a version for each real change; a delete closes the open one and marks it."""
    return versions(steps(staged(changes, keys, data, time, order), keys, data, order), keys, data)


def delete(history: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Close open versions at their key's delete time, if they began by then; deletes: keys, deleted_at."""
    first = deletes.groupBy(*keys).agg(F.min("deleted_at").alias("deleted_at"))
    rows = history.join(first, keys, "left")
    hit = F.col("is_current") & F.coalesce(F.col("valid_from") <= F.col("deleted_at"), F.lit(False))
    return rows.withColumns({"valid_to": F.when(hit, F.col("deleted_at")).otherwise(F.col("valid_to")), "is_deleted": F.when(hit, True).otherwise(F.col("is_deleted")), "is_current": F.when(hit, False).otherwise(F.col("is_current"))}).drop("deleted_at")


def seed(history: DataFrame, snapshot: DataFrame, keys: list[str], data: list[str], at: int) -> DataFrame:
    """History after a reload: rows that changed or are new open a version at `at`; the rest stays."""
    open_ = history.where("is_current").select(*keys, F.struct(*data).alias("_old"))
    rows = snapshot.select(*keys, *data).join(open_, keys, "left").where(~F.struct(*data).eqNullSafe(F.col("_old"))).select(*keys, *data)
    closing = rows.select(*keys, F.lit(True).alias("_closing"))
    hit = F.col("is_current") & F.coalesce("_closing", F.lit(False))
    old = history.join(closing, keys, "left").withColumns({"valid_to": F.when(hit, F.lit(at)).otherwise(F.col("valid_to")), "is_current": F.when(hit, False).otherwise(F.col("is_current"))}).drop("_closing")
    new = rows.withColumns({"valid_from": F.lit(at).cast("long"), "valid_to": F.lit(None).cast("long"), "is_current": F.lit(True), "is_deleted": F.lit(False)})
    return old.unionByName(new)


def align(history: DataFrame, mirror: DataFrame) -> DataFrame:
    """History with the mirror's columns that it lacks, null and of the mirror's type."""
    have = set(history.columns)
    return history.withColumns({f.name: F.lit(None).cast(f.dataType) for f in mirror.schema.fields if f.name not in have})


def as_of(history: DataFrame, at: int) -> DataFrame:
    """Rows as they stood at an instant."""
    return history.where((F.col("valid_from") <= at) & (F.coalesce(F.col("valid_to") > at, F.lit(True))))


def as_of_probes(history: DataFrame, probes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each probe (keys, at) with its key's version of that time, or nulls.

    Probes and versions are laid out together by time, hot keys in slices, and each probe takes the last version before
    it, so a key with many of both costs their sum. A probe with a null key or time gets nulls; of versions that begin
    together the one that is open, else ends last, counts.
    """
    rest = [c for c in history.columns if c not in keys]
    ends = F.struct(F.col("valid_to").isNull(), F.coalesce("valid_to", F.lit(0)))
    begun = history.select(*keys, F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), ends.alias("_tie"), F.struct(*rest).alias("_version"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_probe"))
    asked = probes.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(begun.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(begun.schema["_version"].dataType).alias("_version"), F.struct("*").alias("_probe"))
    rows, order = sliced(begun.unionByName(asked), keys, "_at"), ["_at", "_kind", "_tie"]
    over = _over(rows, keys)
    last = F.last("_version", ignorenulls=True).over(Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if over != keys:
        edges = rows.where(HOT).groupBy(*over).agg(F.max_by("_version", F.when(F.col("_kind") == 0, F.struct(*order))).alias("_edge"))
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
        rows = rows.join(edges.select(*over, F.last("_edge", ignorenulls=True).over(before).alias("_carried")), over, "left")
        last = F.coalesce(last, "_carried")
    found = rows.withColumn("_found", last).where("_kind = 1")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    holds = known & (F.col("_found.valid_from") <= F.col("_at")) & F.coalesce(F.col("_found.valid_to") > F.col("_at"), F.lit(True))
    return found.select("_probe.*", *[F.when(holds, F.col("_found")[c]).alias(c) for c in rest])


def validate(history: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: versions, current ones, and pairs that overlap; a gap is allowed only behind a delete."""
    w = Window.partitionBy(*keys).orderBy("valid_from", F.col("valid_to").isNull(), "valid_to")
    rows = history.withColumn("_next", F.lead("valid_from").over(w))
    follow = F.col("_next").isNotNull()
    return rows.groupBy(*keys).agg(F.count("*").alias("versions"), F.count_if("is_current").alias("current"), F.count_if(follow & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_next")))).alias("overlaps"), F.count_if(follow & (F.col("valid_to") < F.col("_next")) & ~F.col("is_deleted")).alias("gaps"))
