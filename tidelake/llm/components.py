"""Connected components of a links table, in rounds of joins; the few links that are left at last are joined up in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links that one task joins up (some 10 MB there); while there are more, a round of joins shortens their paths.
FEW = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v), FEW at most and all in this task, to each node and the smallest that it reaches, itself left out."""
    ends = [np.zeros((2, 0), np.int64), *(np.stack([col.to_numpy() for col in batch.columns]) for batch in batches)]
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    least = np.arange(len(nodes))  # places in nodes, which are in order
    while (apart := least[u] != least[v]).any():
        a, b = least[u[apart]], least[v[apart]]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least != (further := least[least])).any():
            least = further
    tied = least != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[least[tied]])], ["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """Links (u long, v long) to (node, component): the smallest node reachable.

    While there are more than FEW links, each round ties every node's larger neighbours, then its smaller ones, to the
    smallest; paths halve, so rounds grow with the logarithm of the longest path. Only sums over the whole table reach
    the driver. Loops and repeated links are allowed; null ends are dropped; a component's smallest node and nodes
    without a link to another do not come back.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    while edges.count() > FEW:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every pair is (larger, smaller) here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "links")
        # done when each node has one link, to a node that has none itself
        left = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).where("n > d").select(F.lit(1))
        if edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").limit(1).select(F.lit(1)).union(left).isEmpty():
            return edges.toDF("node", "component")
    return materialize(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
