"""Filters, routing and table selection."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOAD_GATE_ENGINES = ("mssql",)


def exclude_ops(changes: DataFrame, ops: list[str]) -> DataFrame:
    return changes.where(~F.col("op").isin(*ops)) if ops else changes


def route(base: Column, rules: list[dict], fields: dict[str, Column]) -> Column:
    """Topic of a change: that of the first rule whose conditions all hold.

    A rule is {when: {op?, path?, equals?}, topic | topic_suffix}; a path without equals must exist. fields: columns by path.
    """
    out = None
    for rule in rules:
        when, tests = rule.get("when") or {}, []
        if "op" in when:
            tests.append(fields["op"] == when["op"])
        if "path" in when:
            found = fields.get(when["path"], F.lit(None))
            tests.append(F.coalesce(found == F.lit(when["equals"]), F.lit(False)) if "equals" in when else found.isNotNull())
        target = F.lit(rule["topic"]) if "topic" in rule else F.concat(base, F.lit(rule["topic_suffix"])) if "topic_suffix" in rule else base
        if tests:
            cond = reduce(lambda a, b: a & b, tests)
            out = F.when(cond, target) if out is None else out.when(cond, target)
    return base if out is None else out.otherwise(base)


def _usable(patterns: list[str]) -> list[str]:
    """Patterns that the engine that will run them accepts; for each of the others there is a warning."""
    jvm = SparkContext._active_spark_context._jvm
    out = []
    for p in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(f"(?i)^(?:{p})$")
        except IllegalArgumentException as e:
            warnings.warn(f"table pattern {p!r} is left out: {str(e).splitlines()[0]}", stacklevel=3)
            continue
        out.append(p)
    return out


def table_wanted(schema: Column, table: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a table passes lists of patterns that match its name or `schema.table` whole; exclude wins.
    A pattern that is broken matches nothing, and is reported by a warning, as a broken exclude lets tables through."""
    full = F.concat(schema, F.lit("."), table)
    hit = lambda ps: reduce(lambda a, b: a | b, [x.rlike(f"(?i)^(?:{p})$") for p in ps for x in (full, table)], F.lit(False))
    inc, exc = _usable(include), _usable(exclude)
    return (hit(inc) if inc else F.lit(True)) & ~hit(exc)


def is_online_ddl(table: Column) -> Column:
    """Whether a table is a helper of an online schema change."""
    return table.rlike(r"_(gho|ghc|del)$") | table.rlike(r"^_.*_(new|old)$")


def project_policy(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Columns that a policy leaves: exclude first, then include."""
    names = [c for c in rows.columns if c not in set(exclude or ()) and (not include or c in set(include))]
    return rows.select(*names)


def mask(x: Column, kind: str | None) -> Column:
    """A masked cell: the SHA-256 of its text for `hash` or no kind; an empty text stays; other kinds change nothing."""
    return F.when(x == "", "").otherwise(F.sha2(x, 256)) if kind in ("hash", "", None) else x


def split_wanted(changes: DataFrame, catalog: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Add `fate`: wanted, quarantined or unwanted, by equi-joins with the catalog and the held tables."""
    c = catalog.select("catalog_id", F.lit(True).alias("_known")).distinct()
    q = quarantined.select("catalog_id", F.lit(True).alias("_held")).distinct()
    rows = changes.join(c, "catalog_id", "left").join(q, "catalog_id", "left")
    return rows.withColumn("fate", F.when(F.col("_known").isNull(), "unwanted").when(F.col("_held"), "quarantined").otherwise("wanted")).drop("_known", "_held")


def eligible(catalog: DataFrame, signals: DataFrame, pipeline: str) -> DataFrame:
    """Tables that a pipeline ('capture' or 'apply') may work on: active, enabled, keyed, in a fit state, loaded as the
    engine demands, and without a blocking snapshot under way."""
    loaded = ~F.col("needs_full_load")
    gate = loaded if pipeline == "apply" else F.when(F.col("db_engine").isin(*LOAD_GATE_ENGINES), loaded).otherwise(loaded | F.col("capture_during_full_load"))
    fit = F.col("active") & F.col("cdc_enabled") & F.col("has_pk") & ~F.col("status").isin("skipped", "disabled") & gate
    blocking = signals.where((F.col("action") == "execute_blocking") & F.col("status").isin("pending", "running", "paused")).select("catalog_id").distinct()
    return catalog.where(fit).join(blocking, "catalog_id", "left_anti")


def load_targets(catalog: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Tables to load: active, not `never`, waiting, and not under way unless a copy can be resumed."""
    wait = catalog.where(F.col("active") & (F.col("snapshot_mode") != "never") & F.col("needs_full_load"))
    copies = checkpoints.where("phase = 'copy'").select("catalog_id").distinct()
    return wait.where("status <> 'full_load_in_progress'").unionByName(wait.where("status = 'full_load_in_progress'").join(copies, "catalog_id", "left_semi"))


def skip_reasons(catalog: DataFrame) -> DataFrame:
    ready = F.col("cdc_enabled") & ~F.col("needs_full_load") & F.col("has_pk") & ~F.col("status").isin("skipped", "disabled")
    return catalog.where("active").groupBy("conn_id", "db_engine").agg(F.count("*").alias("active_total"), F.count_if("needs_full_load").alias("needs_full_load"), F.count_if(~F.col("cdc_enabled")).alias("cdc_disabled"), F.count_if(~F.col("has_pk")).alias("no_pk"), F.count_if(F.col("status").isin("skipped", "disabled")).alias("skipped_status"), F.count_if(ready).alias("apply_ready"))


def shard(x: Column, n: int) -> Column:
    """Worker of a number, never negative."""
    return F.pmod(x, F.lit(n))


def topic_bucket(schema: Column, table: Column, prefix: str, n: int = 64) -> Column:
    """Topic of a table: its name's SHA-256, first four bytes, modulo the buckets."""
    h = F.conv(F.substring(F.sha2(F.concat(schema, F.lit("."), table), 256), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit(f"{prefix}.b"), F.lpad((h % n).cast("string"), 4, "0"))


def resolve_casefold(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve (schema_name, table_name) to catalog ids: exactly, by lower case, else by the table's name alone, which
    is a mismatch. Adds resolved_id and kind."""
    names = catalog.select("catalog_id", "source_schema", "source_table")
    low = names.groupBy(F.lower("source_schema").alias("ls"), F.lower("source_table").alias("lt")).agg(F.min("catalog_id").alias("low_id"))
    exact = names.groupBy(F.col("source_schema").alias("es"), F.col("source_table").alias("et")).agg(F.min("catalog_id").alias("exact_id"))
    table = names.groupBy(F.lower("source_table").alias("tt")).agg(F.min("catalog_id").alias("table_id"))
    rows = events.join(exact, (F.col("schema_name") == F.col("es")) & (F.col("table_name") == F.col("et")), "left").join(low, (F.lower("schema_name") == F.col("ls")) & (F.lower("table_name") == F.col("lt")), "left").join(table, F.lower("table_name") == F.col("tt"), "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("low_id").isNotNull(), "casefold").when(F.col("table_id").isNotNull(), "schema_mismatch").otherwise("none")
    return rows.select(*events.columns, F.coalesce("exact_id", "low_id").alias("resolved_id"), kind.alias("kind"))


def resolve_key(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the lake key of a change's catalog id where the connection agrees; others are unresolved and go to the DLQ."""
    c = catalog.select("catalog_id", F.col("conn_id").alias("_conn"), F.concat_ws(".", "source_schema", "source_table").alias("lake_key"))
    rows = changes.join(c, "catalog_id", "left")
    ok = F.coalesce(F.col("_conn") == F.col("conn_id"), F.lit(False))
    return rows.withColumns({"lake_key": F.when(ok, F.col("lake_key")), "resolved": ok}).drop("_conn")


def ddl_rotation(catalog: DataFrame, round_: int, every: int = 20) -> DataFrame:
    """Tables to look at for drift this round: any with an error, and every n-th in turn."""
    return catalog.where(F.col("last_error").isNotNull() | (F.col("catalog_id") % every == round_ % every))
