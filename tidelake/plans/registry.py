"""Where queries are registered, and how their oracles read the derived tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")

#: 2024-01-31 00:00 UTC, the instant at which all rules that look at the clock are evaluated.
AS_OF = 1_706_659_200_000

#: Derived tables, in SQL that Spark and DuckDB read alike; MS(x) is a timestamp's milliseconds since 1970.
DERIVED: dict[str, str] = {}


def derive(name: str, sql: str) -> None:
    DERIVED[name] = sql.strip()


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    """Names of derived tables that sql uses, those they need first."""
    out: list[str] = []
    for name in known:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            for x in [*_needed(known[name], known), name]:
                if x not in out:
                    out.append(x)
    return out


def _with(sql: str, extra: str = "") -> str:
    ctes = [f"{n} AS ({DERIVED[n]})" for n in _needed(sql, DERIVED)]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + f"SELECT * FROM ({sql}) q"


def duck(sql: str) -> str:
    return re.sub(r"\bMS\((\w+)\)", r"(epoch_us(\1) // 1000)", _with(sql).replace("{as_of}", str(AS_OF)))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table or a select over derived and given tables."""
    sql = DERIVED.get(sql, sql)
    text = re.sub(r"\bMS\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", _with(sql).replace("{as_of}", str(AS_OF)))
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


class Lake:
    """The derived tables of one folder, read by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return spark_sql(self.spark, self.sf_dir, name)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return spark_sql(self.spark, self.sf_dir, text)


def query(name: str, oracle: str | None = None):
    """Register a function of a Lake under a name; oracle: SQL over the same tables."""

    def register(f: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Lake(spark, sf_dir))
        if oracle:
            ORACLES[name] = duck(oracle)
        return f

    return register
