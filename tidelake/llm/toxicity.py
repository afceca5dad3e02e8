"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on at most `max_labelled` labelled rows (a documented bound), dealt out in shards: each shard
runs FTRL over its rows with a rate per coordinate, and the shards' states are averaged between rounds. L1 leaves a
few thousand weights, so what scoring broadcasts is small and never larger than 2**bits entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, lower_ascii, materialize, mix64, prefix_sums, span_hash, word_spans

BITS = 20
MAX_LABELLED = 20_000
SHARDS = 8
#: Passes of a shard over its rows before the shards' states are averaged, and how often they are.
PASSES, ROUNDS = 2, 2
ALPHA, BETA, L1, L2 = 0.2, 1.0, 3.0, 0.1
THRESHOLD = 0.3
#: Bytes of a word's beginning that count as its stem.
STEMS = (4, 5, 6, 7, 8, 9, 10)

_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def features(buf: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and index of each text's words and stems, word pairs, and pairs with one or two words between."""
    low = lower_ascii(buf)
    s, e, doc = word_spans(low, bounds, _BREAK)
    sums = prefix_sums(low)
    w = span_hash(sums, s, e)
    docs, index = [doc], [mix64(w + np.uint64(1))]
    for size in STEMS:  # an inflected word shares its stem
        longer = e - s > size
        docs.append(doc[longer])
        index.append(mix64(span_hash(sums, s[longer], s[longer] + size) + np.uint64(64 + size)))
    for gap in (1, 2, 3):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            index.append(mix64(w[:-gap][same] * np.uint64(0x9FB21C651E98DF25) + w[gap:][same] + np.uint64(gap)))
    return np.concatenate(docs), (np.concatenate(index) >> np.uint64(64 - bits)).astype(np.int32)


def distinct_features(texts, bits: int) -> list[np.ndarray]:
    """Each text's distinct feature indices."""
    buf, off = byte_column(texts)
    out = []
    for i, j in doc_chunks(off):
        doc, index = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], bits)
        key = np.unique(doc.astype(np.int64) << 32 | index)
        upto = np.searchsorted(key >> 32, np.arange(j - i + 1))
        own = (key & 0xFFFFFFFF).astype(np.int32)
        out += [own[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
    return out


def ftrl_pass(rows, labels, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> None:
    """One pass of FTRL-proximal over rows of feature indices, updating z and n; the last coordinate is the intercept."""
    bias = len(z) - 1
    for x, y in zip(rows, labels, strict=True):
        x = np.append(x, bias)
        zx, nx = z[x], n[x]
        penalty = np.where(x == bias, 0.0, l1)
        root = np.sqrt(nx)
        w = np.where(np.abs(zx) <= penalty, 0.0, (np.sign(zx) * penalty - zx) / ((beta + root) / alpha + l2))
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        g2 = g * g
        z[x] = zx + g - (np.sqrt(nx + g2) - root) / alpha * w
        n[x] = nx + g2


def weights_of(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    penalty = np.full(len(z), l1)
    penalty[-1] = 0
    return np.where(np.abs(z) <= penalty, 0.0, (np.sign(z) * penalty - z) / ((beta + np.sqrt(n)) / alpha + l2))


def _train(state, size: int, bits: int):
    """A shard's labelled texts to its state after PASSES passes, from the common state."""

    def run(key, rows):
        z, n = np.zeros(size), np.zeros(size)
        if state is not None:
            at, z0, n0 = state.value
            z[at], n[at] = z0, n0
        rows = rows.sort_by("order")
        x, y = distinct_features(rows["text"], bits), rows["label"].to_numpy()
        for _ in range(PASSES):
            ftrl_pass(x, y, z, n, ALPHA, BETA, L1, L2)
        at = np.flatnonzero(n > 0)
        return pa.table({"i": at.astype(np.int32), "z": z[at], "n": n[at]})

    return run


def fit_ftrl(labelled: DataFrame, bits: int = BITS, shards: int = SHARDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on rows (order long, label int, text binary): indices and weights that are not zero, and the intercept."""
    size = (1 << bits) + 1
    rows = materialize(labelled, "labelled").withColumn("shard", F.pmod("order", F.lit(shards)))
    state = None
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(state) if state is not None else None
        mixed = rows.groupBy("shard").applyInArrow(_train(shared, size, bits), "i int, z double, n double")
        # as many rows as the model has coordinates, at most 2**bits + 1
        got = mixed.groupBy("i").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
        state = got["i"].to_numpy(), got["z"].to_numpy() / shards, got["n"].to_numpy() / shards
    z, n = np.zeros(size), np.zeros(size)
    z[state[0]], n[state[0]] = state[1], state[2]
    w = weights_of(z, n, ALPHA, BETA, L1, L2)
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def _score(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = w
        for batch in batches:
            buf, off = byte_column(batch.column(batch.num_columns - 1))
            total = np.full(batch.num_rows, bias)
            for i, j in doc_chunks(off):
                doc, index = features(buf[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                used = dense[index] != 0
                key = np.unique(doc[used].astype(np.int64) << 32 | index[used])
                np.add.at(total, i + (key >> 32), dense[key & 0xFFFFFFFF])
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, folds: int = 4, held: int = 2, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every whole text; labels (id_col, label_col 0/1) teach only where crc32(id as text) mod folds is not held.

    Returns every row of docs with held_out, score and predicted added (columns of these names are replaced). At most
    max_labelled labelled rows are used, those with the smallest hash of the id. Rows with a null id or label teach
    nothing; a null or empty text has the intercept's score; without any usable label every score is 0.5. Equal rows
    get equal scores. An empty table gives no rows.
    """
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % folds
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(fold(F.col("id")) != held)
    sample = usable.withColumn("order", F.xxhash64("id")).orderBy("order", "id", "label").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    model = fit_ftrl(texts.join(F.broadcast(sample), "id").select("order", "label", "text"))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    spark = docs.sparkSession
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)) + ", score double"
    shifted = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.col(text_col).cast("binary").alias("bytes"))
    scored = shifted.mapInArrow(_score(spark.sparkContext.broadcast(model), BITS), schema)
    out = scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.coalesce(fold(F.col(f"c{kept.index(id_col)}")) == held, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
