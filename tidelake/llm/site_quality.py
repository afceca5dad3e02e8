"""Quality by hierarchical empirical Bayes over hosts and paths.

Evidence of a text is the log-likelihood ratio of its hashed words under naive Bayes, fitted on at most `max_labelled`
labelled rows and damped for length. Labels also say how good a host and a path within it are: a host's rate is shrunk
toward the global one and a path's toward its host's, with as many pseudo-observations as the spread between sites
supports (method of moments). All site figures are grouped sums; the posterior of a text is its path's log-odds plus
its own evidence, so a sparse site leaves the decision to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, lower_ascii, materialize, mix64, prefix_sums, span_hash, word_spans

BITS = 18
MAX_LABELLED = 20_000
#: Fewest and most pseudo-observations of a parent's rate.
PRIOR = (2.0, 1000.0)
THRESHOLD = 0.5
#: Texts' worth of smoothing for a feature's counts.
RARE = 5.0
#: Sites up to which their figures are broadcast; beyond, they are joined by shuffles that split hot hosts.
BROADCAST_SITES = 50_000

_SHAPES = np.zeros(256, np.uint8)
_SHAPES[:] = 5
_SHAPES[[*range(97, 123)]] = 1
_SHAPES[[*range(65, 91)]] = 2
_SHAPES[[*range(48, 58)]] = 3
_SHAPES[[33, 35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 124, 126, 43, 61]] = 4
_SHAPES[128:] = 1


def features(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and index of each word, and of its first and last byte's kind with its neighbour's."""
    s, e, doc = word_spans(buf, bounds)
    if not len(s):
        return s, s
    w = mix64(span_hash(prefix_sums(lower_ascii(buf)), s, e)) >> np.uint64(64 - BITS)
    shape = _SHAPES[buf[s]].astype(np.int64) * 64 + _SHAPES[buf[e - 1]] * 8 + np.minimum(e - s, 3)
    pair = shape.copy()
    pair[1:] += np.where(doc[1:] == doc[:-1], 512 * (1 + shape[:-1] % 64), 0)
    tag = mix64(pair.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS)
    return np.concatenate([doc, doc]), np.concatenate([w, tag]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to how many of either label have each feature, added up within the task."""
    n = np.zeros((2, 1 << BITS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy()
        buf, off = byte_column(batch.column(1))
        for i, j in doc_chunks(off):
            doc, index = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            key = np.unique(doc << BITS | index)
            np.add.at(n, (label[i + (key >> BITS)], key & ((1 << BITS) - 1)), 1)
            docs += np.bincount(label[i:j], minlength=2)
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], docs[0])), pa.array(np.append(n[1, at], docs[1]))], ["i", "n0", "n1"])


def _evidence(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            buf, off = byte_column(batch.column(batch.num_columns - 1))
            out = np.zeros(batch.num_rows)
            for i, j in doc_chunks(off):
                doc, index = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                key = np.unique(doc << BITS | index)
                d = key >> BITS
                n = np.bincount(d, minlength=j - i)
                out[i:j] = np.bincount(d, w[key & ((1 << BITS) - 1)], j - i) / np.sqrt(np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "evidence"])

    return run


def shrunk(own_good: Column, own_n: Column, parent: Column, strength: float | Column) -> Column:
    """A site's rate with `strength` pseudo-observations of its parent's."""
    s = F.lit(strength) if isinstance(strength, (int, float)) else strength
    return (F.coalesce(own_good, F.lit(0)) + s * parent) / (F.coalesce(own_n, F.lit(0)) + s)


def prior_strength(sites: DataFrame, good: str, n: str, parent: str) -> float:
    """Pseudo-observations by the method of moments: what spread between sites chance does not explain."""
    p = F.col(good) / F.col(n)
    m = F.col(parent)
    r = sites.where(F.col(n) > 0).agg(F.sum(F.col(n) * (p - m) * (p - m)).alias("ss"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col(n) * m * (1 - m)).alias("most"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
    if not r["k"] or not r["most"] or r["n"] == r["k"]:
        return PRIOR[1]
    between = max((r["ss"] - r["chance"]) / max(r["n"] - r["k"], 1), 1e-9)
    within = r["most"] / r["n"]
    return float(min(max(within / between - 1, PRIOR[0]), PRIOR[1]))


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """Posterior probability that a text is good, from its words and from what labels say of its host and path.

    labels (id_col, label_col 0/1) teach only where crc32(id as text) mod folds is not held; the words' weights use at
    most max_labelled of them, the sites all. Returns per row: id_col, held_out, evidence, host_rate, path_rate, score,
    predicted and kept (score at or above the threshold). A host or path without labels has its parent's rate; a null
    one is a site of its own. Null labels and ids teach nothing; a null or empty text has evidence 0. Equal rows get
    equal scores; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % folds
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).where(fold != held)
    rows = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text_col).cast("binary").alias("text"))
    sample = taught.orderBy(F.xxhash64("id"), "id", "label").limit(max_labelled)
    counts = rows.select("id", "text").join(F.broadcast(sample), "id").select("label", "text").mapInArrow(_counts, "i long, n0 long, n1 long")
    table = counts.groupBy("i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2**BITS + 1 rows
    at, n0, n1 = (table[c].to_numpy() for c in ("i", "n0", "n1"))
    total = [int(x[at == -1].sum()) for x in (n0, n1)]
    weights = np.zeros(1 << BITS)
    own = at >= 0
    # rare features are smoothed toward what chance gives, with RARE texts' worth of the labels' own shares
    share = (total[1] + 1) / (sum(total) + 2)
    weights[at[own]] = np.log((n1[own] + RARE * share) / (total[1] + RARE * share)) - np.log((n0[own] + RARE * (1 - share)) / (total[0] + RARE * (1 - share)))
    scored = rows.mapInArrow(_evidence(spark.sparkContext.broadcast(weights)), f"id {id_type}, host string, path string, evidence double")

    # sites: grouped sums over all labels
    seen = rows.select("id", "host", "path").join(taught, "id")
    by_path = materialize(seen.groupBy("host", "path").agg(F.sum("label").alias("good"), F.count("*").alias("n")), "paths")
    whole = by_path.agg(F.sum("good"), F.sum("n")).first()
    rate = (whole[0] + 1) / (whole[1] + 2) if whole[1] else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")).withColumn("rate", F.lit(rate))
    host_strength = prior_strength(by_host, "host_good", "host_n", "rate")
    by_host = by_host.select(F.col("host").alias("h"), shrunk(F.col("host_good"), F.col("host_n"), F.lit(rate), host_strength).alias("host_rate"))
    paths = by_path.join(by_host, by_path["host"].eqNullSafe(F.col("h"))).drop("h")
    path_strength = prior_strength(paths, "good", "n", "host_rate")
    paths = paths.select(F.col("host").alias("ph"), F.col("path").alias("pp"), shrunk(F.col("good"), F.col("n"), F.col("host_rate"), path_strength).alias("path_rate"))
    if by_path.count() <= BROADCAST_SITES:
        by_host, paths = F.broadcast(by_host), F.broadcast(paths)
    joined = scored.join(by_host, scored["host"].eqNullSafe(F.col("h")), "left").join(paths, scored["host"].eqNullSafe(F.col("ph")) & scored["path"].eqNullSafe(F.col("pp")), "left")
    hosts = F.coalesce("host_rate", F.lit(rate))
    sites = F.least(F.greatest(F.coalesce("path_rate", hosts), F.lit(0.001)), F.lit(0.999))
    out = joined.select(F.col("id").alias(id_col), F.coalesce(fold == held, F.lit(False)).alias("held_out"), "evidence", hosts.alias("host_rate"), sites.alias("path_rate"))
    score = 1 / (1 + F.exp(-(F.log(F.col("path_rate") / (1 - F.col("path_rate"))) + F.col("evidence"))))
    return out.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("kept", F.col("score") >= threshold)
