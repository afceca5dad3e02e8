"""Type rules: source types and JSON values to lake types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of lake types, widest last.
NUMERIC_RANK = ("SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "DOUBLE")


def mariadb_type(declared: Column) -> Column:
    """Lake type of a MariaDB column type such as `int(11) unsigned`."""
    d = F.lower(F.trim(declared))
    base = F.regexp_extract(d, r"^([a-z]+)", 1)
    unsigned = F.contains(d, F.lit("unsigned"))
    bits = F.regexp_extract(d, r"^bit\(([0-9]+)\)", 1)
    return (
        F.when(base == "bigint", F.when(unsigned, "NUMERIC").otherwise("BIGINT"))
        .when(base == "bit", F.when((bits == "") | (bits == "1"), "BOOLEAN").otherwise(F.concat(F.lit("BIT("), bits, F.lit(")"))))
        .when(base == "tinyint", "SMALLINT")
        .when(base == "smallint", F.when(unsigned, "INTEGER").otherwise("SMALLINT"))
        .when(base == "mediumint", "INTEGER")
        .when(base.isin("int", "integer"), "BIGINT")
        .when(base.isin("decimal", "numeric"), "DECIMAL")
        .when(base == "double", "DOUBLE")
        .when(base == "float", "REAL")
        .when(base.isin("datetime", "timestamp"), "TIMESTAMPTZ")
        .when(base == "date", "DATE")
        .when(base == "time", "TIME")
        .when(F.contains(base, F.lit("blob")) | F.contains(base, F.lit("binary")), "BYTEA")
        .when(base == "json", "JSONB")
        .otherwise("TEXT")
    )


def mssql_type(name: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Lake type of a SQL Server column from its name, byte length, precision and scale."""
    n = F.lower(F.trim(name))
    chars = F.when(n.startswith("n"), F.floor(length / 2)).otherwise(length)
    return (
        F.when(n.isin("decimal", "numeric"), F.concat(F.lit("NUMERIC("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(n.isin("varchar", "nvarchar", "char", "nchar"), F.when((length == -1) | (chars >= 8000), "TEXT").otherwise(F.concat(F.lit("VARCHAR("), chars.cast("string"), F.lit(")"))))
        .when(n == "int", "INTEGER")
        .when(n == "bigint", "BIGINT")
        .when(n.isin("smallint", "tinyint"), "SMALLINT")
        .when(n == "bit", "BOOLEAN")
        .when(n == "money", "NUMERIC(19,4)")
        .when(n == "smallmoney", "NUMERIC(10,4)")
        .when(n == "float", "DOUBLE")
        .when(n == "real", "REAL")
        .when(n.isin("datetime", "datetime2", "smalldatetime", "datetimeoffset"), "TIMESTAMPTZ")
        .when(n == "date", "DATE")
        .when(n == "time", "TIME")
        .when(n == "uniqueidentifier", "UUID")
        .when(n.isin("varbinary", "binary", "image"), "BYTEA")
        .otherwise("TEXT")
    )


def json_type(value: Column) -> Column:
    """Lake type of one JSON value given as text; null counts as text."""
    v = F.trim(value)
    whole = v.rlike(r"^-?[0-9]+$")
    return (
        F.when(v.isNull() | (v == "null"), "TEXT")
        .when(v.isin("true", "false"), "BOOLEAN")
        .when(whole, F.when(v.try_cast("long").between(-(2**31), 2**31 - 1), "INTEGER").otherwise("BIGINT"))
        .when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "DOUBLE")
        .when(v.startswith("{") | v.startswith("["), "JSONB")
        .otherwise("TEXT")
    )


def resolved_type(types: Column) -> Column:
    """One type for an array of distinct ones: itself alone, JSONB if any is, the widest of numbers, else TEXT."""
    rank = F.array(*[F.lit(x) for x in NUMERIC_RANK])
    numbers = F.forall(types, lambda t: F.array_contains(rank, t))
    widest = F.element_at(rank, F.array_max(F.transform(types, lambda t: F.array_position(rank, t))).cast("int"))
    return F.when(F.size(types) == 1, types[0]).when(F.array_contains(types, F.lit("JSONB")), "JSONB").when(numbers, widest).otherwise("TEXT")


def drift_type(value: Column) -> Column:
    """Type of a column that appears at apply: whole numbers are 64 bit, structures are text."""
    t = json_type(value)
    return F.when(t == "INTEGER", "BIGINT").when(t == "JSONB", "TEXT").otherwise(t)


def infer_schema(entries: DataFrame, key: str, value: str) -> DataFrame:
    """(key, type, rows) from rows of keys and JSON values: types are collected per key and resolved."""
    return entries.groupBy(key).agg(F.array_sort(F.collect_set(json_type(F.col(value)))).alias("types"), F.count("*").alias("rows")).select(key, resolved_type(F.col("types")).alias("type"), "rows")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
