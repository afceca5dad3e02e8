"""Schema drift, type audits and catalog discovery over metadata tables, all tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of types, narrow to wide.
FAMILIES = {"int": ("SMALLINT", "INTEGER", "BIGINT"), "float": ("REAL", "DOUBLE"), "text": ("VARCHAR", "TEXT"), "time": ("DATE", "TIMESTAMPTZ")}


def plan(source: DataFrame, lake: DataFrame, keys: DataFrame) -> DataFrame:
    """Per table: columns added and removed, whether both (perhaps a rename), whether a key column went, and whether
    the source gave no columns at all, which is a failed read and no drift. Inputs: tab, name."""
    s, k = source.select("tab", "name", F.lit(True).alias("s")), keys.select("tab", "name", F.lit(True).alias("k"))
    both = s.join(lake.select("tab", "name", F.lit(True).alias("l")), ["tab", "name"], "full").join(k, ["tab", "name"], "left")
    only = lambda a, b: F.array_sort(F.collect_list(F.when(F.col(a).isNotNull() & F.col(b).isNull(), F.col("name"))))
    rows = both.groupBy("tab").agg(only("s", "l").alias("added"), only("l", "s").alias("removed"), F.coalesce(F.bool_or(F.col("l") & F.col("s").isNull() & F.col("k")), F.lit(False)).alias("pk_removed"), F.count("s").alias("n"))
    gone = F.col("n") == 0
    none = F.array().cast("array<string>")
    return rows.select("tab", F.when(gone, none).otherwise(F.col("added")).alias("added"), F.when(gone, none).otherwise(F.col("removed")).alias("removed"), (~gone & F.col("pk_removed")).alias("pk_removed"), gone.alias("source_unavailable")).withColumn("ambiguous", (F.size("added") > 0) & (F.size("removed") > 0))


def reason(p: DataFrame) -> Column:
    """Why a table must be loaded again, or null."""
    return F.when(F.col("pk_removed"), F.concat(F.lit("key column dropped: "), F.array_join("removed", ", "))).when(F.col("ambiguous"), F.concat(F.lit("possible rename, added: "), F.array_join("added", ", "), F.lit("; dropped: "), F.array_join("removed", ", ")))


def action(p: DataFrame) -> DataFrame:
    """What to do about each table's drift."""
    a = F.when(F.col("source_unavailable"), "wait").when(F.col("pk_removed") | F.col("ambiguous"), "reload").when(F.size("removed") > 0, "drop_columns").when(F.size("added") > 0, "add_columns").otherwise("none")
    return p.select("tab", a.alias("action"), reason(p).alias("reason"))


def drop_columns(rows: DataFrame, removed: list[str], keys: list[str]) -> DataFrame:
    """Rows without removed columns; bookkeeping and key columns never go."""
    return rows.drop(*[c for c in removed if c not in keys and not c.startswith("_dl_")])


def width_family(old: Column, new: Column) -> Column:
    """widen, narrow, same or reload, by the types' family and place in it."""
    base = lambda t: F.regexp_extract(t, "^([A-Z]+)", 1)
    out = F.when(old == new, "same")
    for names in FAMILIES.values():
        rank = F.array(*[F.lit(n) for n in names])
        i, j = F.array_position(rank, base(old)), F.array_position(rank, base(new))
        size = lambda t: F.coalesce(F.regexp_extract(t, r"\((\d+)", 1).try_cast("int"), F.lit(1 << 30))
        out = out.when((i > 0) & (j > 0), F.when(j > i, "widen").when(j < i, "narrow").when(size(new) >= size(old), "widen").otherwise("narrow"))
    return out.otherwise("reload")


def migrate_check(rows: DataFrame, casts: dict[str, str]) -> DataFrame:
    """For each column and its new type, how many values would not fit."""
    bad = rows.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in casts.items()])
    return bad.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("bad"), (F.col(c) == 0).alias("fits")) for c in casts])).alias("x")).select("x.*")


def text_to_binary(x: Column) -> Column:
    return F.encode(x, "UTF-8")


def binary_to_text(x: Column) -> Column:
    """Text of bytes; null if they aren't UTF-8."""
    return F.try_validate_utf8(x.cast("string"))


def nullability(source: DataFrame, lake: DataFrame, keys: DataFrame) -> DataFrame:
    """A column may be null only where source and all lake parts allow it, a key column never. Inputs: tab, name, nullable."""
    l = lake.groupBy("tab", "name").agg(F.every("nullable").alias("lake_nullable"))  # noqa: E741
    rows = source.join(l, ["tab", "name"], "left").join(keys.select("tab", "name", F.lit(True).alias("is_key")).distinct(), ["tab", "name"], "left")
    return rows.select("tab", "name", (F.col("nullable") & F.coalesce("lake_nullable", F.lit(True)) & F.col("is_key").isNull()).alias("nullable"))


def sensitive(declared: Column) -> Column:
    """Whether a column's type is one whose coercion rules changed over time."""
    d = F.lower(declared)
    return d.rlike(r"^(bit|bool|boolean|tinyint\(1\)|date|time|datetime)") | d.rlike("^(timestamp|datetime2|smalldatetime|datetimeoffset)")


def coercion_audit(columns: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(findings, tables): sensitive columns of an old rule version or with another lake type than the rules give.
    Input: tab, name, declared, expected, lake_type, rule_version (-1 without metadata)."""
    stale, wrong = F.col("rule_version") < version, F.col("lake_type") != F.col("expected")
    found = columns.where(sensitive(F.col("declared")) & (stale | wrong)).withColumn("finding", F.when(wrong, "type_mismatch").otherwise("stale_rules"))
    return found.select("tab", "name", "finding"), found.groupBy("tab").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("report"))


def discover(catalog: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog against what a source shows: each object's fate, keep, add or prune."""
    a, b = catalog.select(*keys, F.lit(True).alias("a")), found.select(*keys, F.lit(True).alias("b"))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "prune").otherwise("keep").alias("fate"))


def cascade(positions: DataFrame, pruned: DataFrame) -> DataFrame:
    """Positions without those of pruned tables."""
    return positions.join(pruned.select("catalog_id"), "catalog_id", "left_anti")


def key_list(columns: DataFrame) -> DataFrame:
    """Each table's key columns in order as a comma list. Input: tab, name, place."""
    return columns.groupBy("tab").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda c: c["name"]), ",").alias("pk_columns"), F.lit(True).alias("has_pk"))
