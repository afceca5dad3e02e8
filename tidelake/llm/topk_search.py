"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. Index rows are dealt into shards by id; a shard's index keeps, for each dimension,
its vectors in order of their impact in segments of equal size, from both ends, since a query's component may have
either sign. For a small block of queries the segments of all dimensions are processed by descending contribution, each
adding its scores to accumulators and lowering what its dimension can still add. The walk stops only on proof: when no vector
outside the possible members can reach the k-th best lower bound. The possible members are then scored exactly.
A shard's index is built once, and the blocks of queries stream past it, so neither grows with the other in memory; the
shards' best k are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Components that a shard holds, whose index takes some 20 bytes for each; queries that meet it together.
SHARD_VALUES = 1 << 18
QUERY_BLOCK = 2048
QUERIES_AT_ONCE = 32
#: Segments of a dimension, and tests of the stopping rule in a walk.
SEGMENTS = 8
TESTS = 8
#: The walk stops once no more than one vector in so many can be a member; those are scored exactly.
RESCORED = 8
MOST_PARTITIONS = 20_000


class ImpactIndex:
    """Postings of each dimension sorted by impact and cut into segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T).astype(np.int32)  # by dimension, ascending
        # sums below 2**52 are exact as doubles, which are faster
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * dims * 4 < 2**52
        self.impact = np.ascontiguousarray(np.take_along_axis(vectors.T, self.order.astype(np.int64), 1)).astype(np.float64 if self.exact else np.int64)
        self.cuts = np.unique(np.append(np.linspace(0, n, SEGMENTS + 1).astype(np.int64), n))
        # impact at each segment's upper and lower end, for either direction of the walk
        self.top, self.bottom = self.impact[:, self.cuts[1:] - 1], self.impact[:, self.cuts[:-1]]
        self.low, self.high = self.impact[:, 0], self.impact[:, -1]

    def search(self, queries: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each query of a small block, the k highest (score, id, place); ties to smaller ids.

        The block walks the segments by the best that they can add to any of its queries; bounds and proofs are each
        query's own.
        """
        n, dims = self.vectors.shape
        m, segments = len(queries), len(self.cuts) - 1
        kind = self.impact.dtype if float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * dims * 4 < 2**52 else np.dtype(np.int64)
        q = np.ascontiguousarray(queries.T).astype(kind)  # by dimension
        least = np.minimum(q * self.low[:, None], q * self.high[:, None])
        # the most that a posting of a segment adds to a query, above the least of its dimension
        gain = np.maximum(q[:, None, :] * self.top[:, :, None], q[:, None, :] * self.bottom[:, :, None]) - least[:, None, :]
        walk = np.argsort(-gain.max(axis=2).ravel(), kind="stable")
        impact = self.impact.astype(kind, copy=False)
        base = least.sum(axis=0)
        want = min(k, n)
        acc = np.zeros((n, m), kind)
        step = max(1, len(walk) // TESTS)
        possible = np.ones((n, m), bool)
        for at in range(0, len(walk), step):
            for x in walk[at : at + step].tolist():
                d, s = divmod(x, segments)
                lo, hi = self.cuts[s], self.cuts[s + 1]
                add = impact[d, lo:hi, None] * q[d]
                add -= least[d]
                acc[self.order[d, lo:hi]] += add
                gain[d, s] = 0
            if at < len(walk) // 4:
                continue
            # a vector not yet met in a dimension gains there no more than the best segment left
            rest = gain.max(axis=1).sum(axis=0) + base
            few = np.argpartition(acc, max(0, n - k - 28), axis=0)[max(0, n - k - 28) :]
            floor = np.zeros(m, kind)
            for j in range(m):
                # the k-th best of some exact scores: no member of the answer is below it
                floor[j] = np.sort(self.vectors[few[:, j]] @ queries[j])[-want]
            possible = acc >= floor - rest
            if possible.sum(axis=0).max() <= max(4 * k, n // RESCORED):
                break
        out = []
        for j in range(m):
            rows = np.flatnonzero(possible[:, j])
            score = self.vectors[rows] @ queries[j]
            if len(rows) > want:
                edge = np.partition(score, len(rows) - want)[len(rows) - want]
                rows, score = rows[score >= edge], score[score >= edge]
            out.append([(-s, i, at) for s, i, at in sorted(zip((-score).tolist(), self.ids[rows].tolist(), rows.tolist(), strict=True))[:want]])
        return out


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that are not null and hold only finite numbers: floor(scale * x), x as double."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda y: F.floor(y * scale)).alias("v"))


_BLOCK = "block int, dims int, keys binary, ids binary, values binary"


def _pack(key, table):
    """Rows of one block and length, in order of their ids."""
    table = table.sort_by([("id", "ascending"), ("key", "ascending")])
    flat = table["v"].combine_chunks()
    values = (flat.values if isinstance(flat, pa.ListArray) else flat.flatten()).to_numpy()
    raw = lambda name: [table[name].to_numpy().astype("<i8").tobytes()]
    schema = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("values", pa.binary())])
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([key[1].as_py()], pa.int32()), "keys": raw("key"), "ids": raw("id"), "values": [values.astype("<i8").tobytes()]}, schema=schema)


def _matrix(row: dict, name: str = "values") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, vectors) of a block."""
    ids = np.frombuffer(row["ids"], "<i8")
    return np.frombuffer(row["keys"], "<i8"), ids, np.frombuffer(row[name], "<i8").reshape(len(ids), row["dims"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard, and behind it all blocks of queries: the shard's index is built once."""
        index = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    _, ids, vectors = _matrix(row)
                    index, shard = ImpactIndex(ids, vectors), (row["shard"], row["dims"])
                elif index is not None and shard == (row["shard"], row["dims"]):
                    keys, asked, queries = _matrix(row)
                    found: list[tuple[int, int, int, int, bool]] = []
                    for at in range(0, len(keys), QUERIES_AT_ONCE):
                        part = slice(at, at + QUERIES_AT_ONCE)
                        # one more than asked for, as the query's own row may be among them
                        for key, q, v, rows in zip(keys[part].tolist(), asked[part].tolist(), queries[part], index.search(queries[part], k + 1), strict=True):
                            found += [(key, q, i, s, i == q and bool((index.vectors[place] == v).all())) for s, i, place in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.bool_() if j == 4 else pa.int64()) for j in range(5)], ["key", "query_id", "vec_id", "score", "same"])

    return run


def topk_search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest integer inner products of every query with the vectors but its own: query_id, rank, vec_id, score.

    Components become floor(scale * x). Ties go to the smaller vec_id. A query's own row is one with its id and its
    components; a row that comes twice is a candidate for its copy, and two equal query rows have k rows each. Vectors
    or queries that are null, have a null id, or hold a null or a non-finite component take no part; vectors of another
    length than the query's are not compared with it. Fewer than k candidates are all returned. Empty tables give no rows.
    """
    keyed = lambda rows, tag: materialize(quantised(rows, id_col, vector_col, scale).withColumn("dims", F.size("v")).where("dims > 0").withColumn("key", F.monotonically_increasing_id()), tag)
    data, asked = keyed(vectors, "vectors"), keyed(queries, "queries")
    longest = data.agg(F.max("dims")).first()[0] or 1
    per_shard = max(64, SHARD_VALUES // longest)
    shards, held = _packed(data, per_shard)
    _, sent = _packed(asked, min(QUERY_BLOCK, per_shard))
    # the stated queries, in blocks, past every shard; a shard is sent once, and each task has whole shards
    rest = ["dims", "keys", "ids", "values"]
    left = held.select(F.col("block").alias("shard"), F.lit(0).alias("kind"), *rest)
    right = sent.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), *rest)
    partitions = min(shards, MOST_PARTITIONS)
    dealt = left.unionByName(right).repartitionById(partitions, F.col("shard") % partitions).sortWithinPartitions("shard", "dims", "kind")
    best = dealt.mapInArrow(_search(k), "key long, query_id long, vec_id long, score long, same boolean")
    # k + 1 rows of each shard at most, and of those k + 1
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", F.desc("same")))
    first = best.withColumn("place", rank).where(F.col("place") <= k + 1)
    # one row that is the query's own goes, and those behind it move up
    own = first.withColumn("own", F.min(F.when(F.col("same"), F.col("place"))).over(Window.partitionBy("key")))
    moved = F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)
    return own.where("own is null or place <> own").withColumn("rank", moved).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _packed(rows: DataFrame, per: int) -> tuple[int, DataFrame]:
    """Blocks of about `per` rows, however often an id comes: how many, and a row for each of (block, dims)."""
    blocks = max(1, -(-rows.count() // per))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).cast("int"))
    return blocks, materialize(numbered.groupBy("block", "dims").applyInArrow(_pack, _BLOCK), "blocks")
