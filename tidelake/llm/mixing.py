"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are put in a random order by a hash and cut into blocks. What the mix takes of a source is a number
of whole passes over its blocks, the first blocks of one more pass, and, in the block where its target falls, the
documents that still fit. The blocks taken are then dealt to output shards: a binary tree over the shards splits every
source's exact number of blocks at each node by a multivariate hypergeometric draw, so each shard is a random sample of
the whole mix and no block is drawn twice. Each shard takes the next run of each source's permuted blocks and shuffles
its documents locally. Only counts by source reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, materialize, whole_row, word_spans

#: Documents that a block holds on average, and the most blocks of a source.
BLOCK_DOCS = 64
MAX_BLOCKS = 1 << 16
#: Documents of a shard on average, and the fewest shards.
SHARD_DOCS, LEAST_SHARDS = 20_000, 16
#: Nodes times sources of the tree's top, which the driver splits; below, tasks do.
TOP_ENTRIES = 1 << 16
#: Sources up to which their figures are broadcast.
BROADCAST_SOURCES = 20_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut off goes to the others by weight."""
    target = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    for i in range(len(sizes)):
        target[i] = 0.0
    rest = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / weight
            break
        for i in full:
            target[i] = most * sizes[i]
        rest -= sum(target[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return target


def hypergeometric(draw, good: int, bad: int, take: int) -> int:
    """How many good ones are among `take` of good and bad. The generator draws from less than 10**9; beyond, by inversion."""
    return int(draw.hypergeometric(good, bad, take)) if good + bad < 10**9 else by_inversion(draw, good, bad, take)


def by_inversion(draw, good: int, bad: int, take: int) -> int:
    """The same draw at any size: weights go outward from the mode, whose own comes from log-gammas."""
    lo, hi = max(0, take - bad), min(good, take)
    if lo == hi:
        return lo
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(hi, max(lo, (good + 1) * (take + 1) // (good + bad + 2)))
    u = draw.random()
    up = down = math.exp(log_choose(good, mode) + log_choose(bad, take - mode) - log_choose(good + bad, take))
    u -= up
    i = j = mode
    while u > 0 and (i < hi or j > lo):
        if i < hi:
            up *= (good - i) / (i + 1) * (take - i) / (bad - take + i + 1)
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > lo:
            down *= j / (good - j + 1) * (bad - take + j) / (take - j + 1)
            j -= 1
            u -= down
            if u <= 0:
                return j
        if up + down < 1e-18:
            break
    return mode


def split_node(have: np.ndarray, lo: int, hi: int, seed: int) -> np.ndarray:
    """What the left half of the shards lo to hi takes of each source: a multivariate draw, one source after the other."""
    draw = np.random.Generator(np.random.PCG64([seed, lo, hi]))
    take, rest = int(have.sum()) * ((lo + hi) // 2 - lo) // (hi - lo), int(have.sum())
    left = np.zeros_like(have)
    for i, n in enumerate(have):
        rest -= int(n)
        left[i] = hypergeometric(draw, int(n), rest, take)
        take -= int(left[i])
    return left


def split_tree(counts: np.ndarray, shards: int, seed: int, lo: int = 0) -> np.ndarray:
    """Blocks of each source for each shard from lo on: rows are shards, columns sources; every column's sum is its count."""
    return np.array([x for _, _, x in split_down(counts.astype(np.int64), lo, lo + shards, seed, shards)], np.int64).reshape(shards, len(counts))


def split_down(have: np.ndarray, lo: int, hi: int, seed: int, nodes: int) -> list[tuple[int, int, np.ndarray]]:
    """(lo, hi, blocks of each source) of the tree's nodes, in order, at the first level that has `nodes` or is the last."""
    level = [(lo, hi, have)]
    while len(level) < nodes and any(b - a > 1 for a, b, _ in level):
        below = []
        for a, b, x in level:
            if b - a == 1:
                below.append((a, b, x))
                continue
            left = split_node(x, a, b, seed)
            below += [(a, (a + b) // 2, left), ((a + b) // 2, b, x - left)]
        level = below
    return level


def _subtrees(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A node of the tree to its shards: the run of numbers nth of each source's blocks that a shard takes."""
        for batch in batches:
            for row in batch.to_pylist():
                have, at = np.array(row["have"], np.int64), np.array(row["before"], np.int64)
                for lo, _, own in split_down(have, row["lo"], row["hi"], seed, row["hi"] - row["lo"]):
                    some = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), lo), pa.int32()), pa.array(at[some], pa.int64()), pa.array(own[some], pa.int64())], ["sid", "shard", "first", "n"])
                    at = at + own

    return run


def shard_runs(spark: SparkSession, counts: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(sid, shard, first, n): what split_tree tells, the tree's top made here and the subtrees below it by tasks."""
    nodes = split_down(counts.astype(np.int64), 0, shards, seed, max(1, TOP_ENTRIES // max(1, len(counts))))
    before = np.cumsum([np.zeros(len(counts), np.int64), *[x for _, _, x in nodes[:-1]]], axis=0)
    rows = [(lo, hi, x.tolist(), b.tolist()) for (lo, hi, x), b in zip(nodes, before, strict=True)]
    top = spark.createDataFrame(rows, "lo int, hi int, have array<long>, before array<long>")
    return top.repartition(min(len(rows), 1024), "lo").mapInArrow(_subtrees(seed), "sid int, shard int, first long, n long")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = byte_column(batch.column(batch.num_columns - 1))
        n = np.zeros(batch.num_rows, np.int64)
        for i, j in doc_chunks(off):
            n[i:j] = np.bincount(word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i])[2], minlength=j - i)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*batch.schema.names[:-1], "size"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mix documents so that each source's words come near its share. Returns (plan, mix).

    plan has a row per document: id_col, size (words), source_size, target, taken (words, repeats counted), passes (how
    often the document is taken) and the key k. mix has a row per document taken each time: id_col, k, copy, shard and
    position (its place in the shard, by a hash). Sources in order of their code points, null last, have the weights in turn and
    share all words; a target stops at `most` times its source's size. Reruns agree: all choices follow from the seed,
    the row. Only rows equal in all columns have equal keys; they are taken alike in a block but for the last one that
    fits. Rows that share id and text but differ in another column, as in their source, are documents of their own. A
    null or empty text has size 0 and is taken as its block is. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _key(docs, seed, id_col, text_col).alias("k"), F.col(text_col).cast("binary").alias("text"))
    sized = materialize(rows.mapInArrow(_word_counts, f"id {id_type}, source string, k long, size long"), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    # one row for each source
    sources = sorted(by_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))], sum(sizes), most)
    blocks = [max(1, min(MAX_BLOCKS, r["docs"] // BLOCK_DOCS)) for r in sources]
    passes = [min(most, int(t // s)) if s else 0 for s, t in zip(sizes, targets, strict=True)]
    rest = [max(0, int(round(t - p * s))) if p < most else 0 for s, t, p in zip(sizes, targets, passes, strict=True)]
    spark = docs.sparkSession
    facts = spark.createDataFrame([(i, r["source"], s, float(t), b, p, q) for i, (r, s, t, b, p, q) in enumerate(zip(sources, sizes, targets, blocks, passes, rest, strict=True))], "sid int, source string, source_size long, target double, blocks int, passes int, rest long")
    sent = F.broadcast if len(sources) <= BROADCAST_SOURCES else lambda x: x
    facts = sent(facts)
    in_block = F.floor(F.shiftrightunsigned("k", 32).cast("double") / F.lit(2.0**32) * F.col("blocks")).cast("int")
    dealt = sized.join(facts, sized["source"].eqNullSafe(facts["source"])).drop(facts["source"]).withColumn("block", in_block)
    per_block = dealt.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    # at most MAX_BLOCKS rows for each source
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = per_block.withColumn("before", before).select("sid", "block", F.when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(-1).alias("state"), (F.col("rest") - F.col("before")).alias("room"))
    placed = materialize(dealt.join(state, ["sid", "block"]), "blocks")
    settled = placed.where("state >= 0").withColumn("extra", F.col("state"))
    last = placed.where("state < 0").groupBy("sid").applyInArrow(_fit, _typed(placed) + ", extra int")
    chosen = settled.select(*placed.columns, F.col("extra").cast("int").alias("extra")).unionByName(last)
    plan = chosen.withColumn("passes", F.col("passes") + F.col("extra")).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), "passes", "k", "sid", "block")
    # a unit is one block in one pass
    units = materialize(state.join(facts.select("sid", "passes", "blocks"), "sid").select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("passes") + F.when(F.col("state") != 0, 1).otherwise(0))).alias("copy"), "passes", "state").where((F.col("copy") < F.col("passes")) | ((F.col("copy") == F.col("passes")) & (F.col("state") != 0))), "units")
    counts = {r["sid"]: r["n"] for r in units.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    shards = shards or shard_number(sum(r["docs"] for r in sources))
    totals = np.array([counts.get(i, 0) for i in range(len(sources))], np.int64)
    runs = shard_runs(spark, totals, shards, seed).select("sid", "shard", F.posexplode(F.sequence("first", F.expr("first + n - 1")))).select("sid", "shard", F.col("col").alias("nth"))
    nth = F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), "sid", "block", "copy"), "block", "copy")) - 1
    # at most most + 1 times MAX_BLOCKS rows for each source
    to_shard = units.withColumn("nth", nth.cast("long")).join(runs, ["sid", "nth"]).select("sid", "block", "copy", "shard")
    taken = plan.where("passes > 0").select(id_col, "k", "sid", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"))
    mix = taken.join(to_shard, ["sid", "block", "copy"]).select(id_col, "k", "copy", "shard", F.xxhash64(F.lit(seed), "shard", "k", "copy").alias("position"))
    return plan.drop("sid", "block"), mix


def _key(docs: DataFrame, seed: int, id_col: str, text_col: str) -> Column:
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in (id_col, text_col)]
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.to_json(F.struct(*[c.alias(str(i)) for i, c in enumerate(rest)])) if rest else F.lit(None))


def shard_number(docs: int) -> int:
    return max(LEAST_SHARDS, -(-docs // SHARD_DOCS))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 7, **mix) -> DataFrame:
    """The mix itself: rows of docs, all their columns, as often as taken, dealt to their shards and shuffled there.

    Without a number of shards there is one for each SHARD_DOCS documents.
    """
    shards = shards or shard_number(docs.count())
    _, taken = mix_sources(docs, id_col, text_col, source_col, shards=shards, seed=seed, **mix)
    # rows of one key are equal in all columns, so it is all the same which of them stands for the others
    keyed = docs.select(F.col(id_col).alias("id"), _key(docs, seed, id_col, text_col).alias("k"), whole_row(docs).alias("row")).dropDuplicates(["id", "k"])
    taken = taken.select(F.col(id_col).alias("taken_id"), "k", "shard", "position")
    placed = keyed.join(taken, (keyed["k"] == taken["k"]) & keyed["id"].eqNullSafe(taken["taken_id"])).select("row", "shard", "position")
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "position").select("row.*")


def _typed(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _fit(key, table):
    """The one block of a source that its target cuts: documents in hash order that still fit."""
    table = table.sort_by([("k", "ascending")])
    room = table["room"][0].as_py()
    extra = np.zeros(table.num_rows, np.int32)
    for i, n in enumerate(table["size"].to_numpy()):
        if n <= room:
            extra[i] = 1
            room -= n
    return table.append_column("extra", pa.array(extra))
