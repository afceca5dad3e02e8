"""Scratch tables in the folder that the executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Estimated bytes of one split of a scan; of a task of costly work on each row, where the estimate is of packed rows; the
#: most such tasks; and an estimate that tells nothing.
SMALL_BYTES, TASK_BYTES, MOST_TASKS, UNKNOWN_BYTES = 128 << 20, 2 << 20, 20_000, 1 << 50


@functools.cache
def _own_dir(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidelake-")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own, and a
    cluster's is refused."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder that doesn't exist yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: df written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, which the optimizer knows: joins with it go away, and no Python worker starts for it."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def estimated_bytes(df: DataFrame) -> int:
    """The size of df as Spark's optimizer estimates it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, task_bytes: int = SMALL_BYTES) -> DataFrame:
    """df dealt out to tasks of some task_bytes, one for each core at least: its files may come down to few splits, and a
    split of packed rows may be many minutes of costly work. What has no estimate stays as it is."""
    size = estimated_bytes(df)
    if size >= UNKNOWN_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-size // task_bytes))))
