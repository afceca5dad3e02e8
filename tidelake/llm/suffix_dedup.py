"""Suffix-array dedup with a run-length index.

Every text position p of length >= n starts a window of n bytes. The operator removes each byte that lies in a window
which also starts at another position of the corpus, in the same text or another.

How the work is dealt out: a window's anchor is its position with the smallest k-gram hash, so equal windows have equal
anchors at equal distances. Consecutive windows with one anchor make a segment (some 600 bytes). Segments meet by
anchor hash; only those whose anchor occurs elsewhere go on, and identical ones (by a 64-bit hash) are counted and kept
once. Their bytes are cut from the texts, and the texts are shuffled once for that and for the removal. For the
segments of many anchors at a time, a task builds a run-compressed Burrows-Wheeler transform with suffix samples at run
ends. All that is kept of the suffix order are those samples: the match of any other position follows
from the nearest sample before it (phi), so matching statistics are streamed along the text, and windows whose match
is n bytes or longer are marked. Segments of one anchor that are more than an index takes get longer anchors: the whole
window is its own anchor then, so that equal segments are all that can meet, and counting them over the cluster decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, BYTE_VALUES, CHUNK_BYTES, byte_column, doc_chunks, materialize, mix64, prefix_sums, span_hash

GRAM = 32
#: Distinct segments of an anchor that one index takes; beyond, each window is its own anchor.
INDEX_SEGMENTS = 2000
#: Text of one index; a task's memory is about 60 times this.
INDEX_BYTES = 1 << 20
_POS_BITS = np.uint64(22)
_POS_MASK = np.uint64((1 << 22) - 1)
SEPARATOR = 0xFF  # never part of UTF-8


# ---------------------------------------------------------------- the index


class RunLengthIndex:
    """Run-compressed BWT of texts (joined by a byte that UTF-8 never has), with suffix samples at both ends of runs.

    Suffixes are ordered by as many bytes as the longest text has. Every text start is a sampled run end, so a match
    that is read on along its text never outlives what was compared.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.depth = max(map(len, texts), default=0) + 1
        self.buf = np.frombuffer(b"".join(x + b"\xff" for x in texts), dtype=np.uint8)
        lengths = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        n = self.n = len(self.buf)
        self._words = self._eight_bytes()
        sa = self._order()  # not kept
        before = np.empty(n, np.int16)
        before[0] = -1
        before[1:] = self.buf[:-1]
        before[self.starts] = -1
        bwt = before[sa]
        head = np.ones(n, bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:] - 1, n - 1)
        self.run_bytes = bwt[heads]
        self.run_lengths = tails - heads + 1
        #: Text positions at each run's head and tail, with the length of the match to the neighbour outside the run.
        self.head_sample, self.tail_sample = sa[heads], sa[tails]
        self.head_match = np.zeros(len(heads), np.int32)
        self.head_match[1:] = self._common(sa[heads[1:] - 1], sa[heads[1:]])
        self.tail_match = np.zeros(len(heads), np.int32)
        self.tail_match[:-1] = self.head_match[1:]
        del self._words

    def _eight_bytes(self) -> np.ndarray:
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        return np.lib.stride_tricks.sliding_window_view(padded, 8)[: self.n].copy().view(">u8").ravel().astype(np.uint64)

    def _order(self) -> np.ndarray:
        n = self.n
        sa = np.argsort(self._words, kind="stable").astype(np.int32)
        w = self._words[sa]
        first = np.ones(n, bool)
        first[1:] = w[1:] != w[:-1]
        idx = np.arange(n, dtype=np.int32)
        at = np.maximum.accumulate(np.where(first, idx, 0)).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[sa] = at
        tied = ~first
        tied[:-1] |= ~first[1:]
        open_ = np.flatnonzero(tied).astype(np.int32)
        h = 8
        while h < self.depth and len(open_):
            sub = sa[open_]
            nxt = sub.astype(np.int64) + h
            second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)].astype(np.int64) + 1, 0)
            key = rank[sub].astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            sub, key = sub[order], key[order]
            sa[open_] = sub
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.maximum.accumulate(np.where(new, open_, 0))
            rank[sub] = at
            still = ~new
            still[:-1] |= ~new[1:]
            open_ = open_[still]
            h *= 2
        return sa.astype(np.int64)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, up to depth."""
        out = np.zeros(len(a), np.int32)
        live = np.arange(len(a))
        words = np.concatenate([self._words, np.zeros(1, np.uint64)])
        for t in range(0, self.depth, 8):
            x = words[np.minimum(a[live] + t, self.n)]
            y = words[np.minimum(b[live] + t, self.n)]
            diff = x ^ y
            same = diff == 0
            out[live[same]] = t + 8
            rest = live[~same]
            if len(rest):
                d = diff[~same]
                lead = np.zeros(len(d), np.int32)
                for j in range(7):
                    lead += (d >> np.uint64(8 * (7 - j))) == 0
                out[rest] = t + lead
            live = live[same]
            if not len(live):
                break
        return np.minimum(out, self.depth)

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match with a suffix elsewhere (exact within its text).

        Read along the text: at a sampled run end the match is known; one step on, it is shorter by one byte.
        """
        pos = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for sample, match in ((self.head_sample, self.head_match), (self.tail_sample, self.tail_match)):
            known = np.zeros(self.n, bool)
            known[sample] = True
            value = np.zeros(self.n, np.int64)
            value[sample] = match
            last = np.maximum.accumulate(np.where(known, pos, 0))
            np.maximum(best, value[last] - (pos - last), out=best)
        return best

    def repeated_windows(self, counts: np.ndarray) -> list[np.ndarray]:
        """For each text, which of its windows of `length` bytes also stand elsewhere; counts: copies of each text."""
        stats, size = self.matching_statistics() >= self.length, self.length
        ends = np.append(self.starts[1:], self.n) - 1
        return [stats[s : max(s, e - size + 1)] if c < 2 else np.ones(max(0, e - s - size + 1), bool) for s, e, c in zip(self.starts, ends, counts, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


# ---------------------------------------------------------------- stages inside tasks


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = BYTE_VALUES[buf]
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
        width *= 2
    return mix64(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def window_segments(buf: np.ndarray, bounds: np.ndarray, size: int):
    """Segments of texts in buf: text number, first window's start in buf, number of windows, anchor hash, own hash."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(buf) < size:
        return empty
    grams = _gram_hashes(buf)
    keyed = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(keyed, size - GRAM + 1) & _POS_MASK).astype(np.int64)
    n = len(anchor)
    fits = np.zeros(n + 1, np.int32)
    long_enough = np.flatnonzero(bounds[1:] - bounds[:-1] >= size)
    if not len(long_enough):
        return empty
    np.add.at(fits, bounds[long_enough], 1)
    np.add.at(fits, bounds[long_enough + 1] - size + 1, -1)
    fits = np.cumsum(fits[:n]) > 0
    new = fits.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    new[bounds[long_enough]] = True
    last = fits.copy()
    last[:-1] &= new[1:] | ~fits[1:]
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    q = anchor[a]
    own = span_hash(prefix_sums(buf), a, b + size) + mix64((q - a).astype(np.uint64) << np.uint64(20))
    return np.searchsorted(bounds, a, side="right") - 1, a, b - a + 1, grams[q], own


def _pieces(buf: np.ndarray, off: np.ndarray, size: int):
    """Chunks of whole texts, long texts in pieces that overlap by size - 1 bytes: rows, bytes, bounds, place in the text."""
    for i, j in doc_chunks(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= 4 * CHUNK_BYTES:
            yield i, buf[lo:hi], off[i : j + 1] - lo, 0
        else:
            for at in range(0, hi - lo, CHUNK_BYTES):
                part = buf[lo + at : min(hi, lo + at + CHUNK_BYTES + size - 1)]
                yield i, part, np.array([0, len(part)]), at


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_column(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for i, part, bounds, at in _pieces(buf, off, size):
                doc, a, windows, anchor, own = window_segments(part, bounds, size)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(key[i + doc]), pa.array(a - bounds[doc] + at), pa.array(windows.astype(np.int32))], ["a", "s", "k", "at", "w"])

    return run


def _cut(size: int):
    """(key, id, text, places of segments) to the segments' bytes; equal rows are cut once or a few times.

    Place by g: an anchor's segments lie together, those of an anchor with more than an index takes anywhere.
    """

    def rows(out: list[list]) -> pa.RecordBatch:
        a, owns, counts, hot, texts = out
        places = [s if h else x for x, s, h in zip(a, owns, hot, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(a, pa.int64()), pa.array(owns, pa.int64()), pa.array(counts, pa.int64()), pa.array([bytes(x) for x in texts], pa.binary()), pa.array(hot, pa.bool_())], ["g", "a", "s", "m", "bytes", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0
            for k, text, segs in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if k in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(k)
                raw = text.as_buffer()
                for x in segs.as_py():
                    piece = raw[x["at"] : x["at"] + x["w"] + size - 1]
                    for col, v in zip(out, (x["a"], x["s"], x["m"], x["hot"], piece), strict=True):
                        col.append(v)
                    held += len(piece)
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [[], [], [], [], []], 0
            if out[0]:
                yield rows(out)

    return run


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _index(size: int):
    """Segments sorted by anchor and hash, to the ranges of windows that repeat; whole anchors go into an index together,
    and a segment that comes again does not. Those of anchors with more than an index takes are left to _windows."""

    def settle(keys: list, owns: list, counts: list, texts: list) -> pa.RecordBatch:
        marks = RunLengthIndex(texts, size).repeated_windows(np.array(counts))
        rows = [(a, s, [{"lo": lo, "hi": hi} for lo, hi in _ranges(f)]) for a, s, f in zip(keys, owns, marks, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _RANGES)], ["a", "s", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        owns: list = []
        counts: list = []
        texts: list = []
        held = 0
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(5)))
            for a, s, m, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if keys and a == keys[-1] and s == owns[-1]:
                    continue
                if held >= INDEX_BYTES and a != keys[-1]:
                    yield settle(keys, owns, counts, texts)
                    keys, owns, counts, texts, held = [], [], [], [], 0
                raw = text.as_py()
                keys.append(a)
                owns.append(s)
                counts.append(m)
                texts.append(raw)
                held += len(raw)
        if keys:
            yield settle(keys, owns, counts, texts)

    return run


def _windows(size: int):
    """Each window of a segment with its hash, for anchors with more segments than an index takes. The segments are
    sorted by anchor and hash, and one that comes again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            batch = batch.filter(batch.column(5))
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            batch = batch.filter(pa.array([x != y for x, y in zip(names, [before, *names], strict=False)], pa.bool_()))
            before = names[-1] if names else before
            buf, off = byte_column(batch.column(4))
            for i, j in doc_chunks(off):
                part, bounds = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                n = bounds[1:] - bounds[:-1] - size + 1
                row = np.repeat(np.arange(i, j), n)
                w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = bounds[row - i] + w
                h = span_hash(prefix_sums(part), start, start + size)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(w.astype(np.int32)), pa.array(h.view(np.int64))], ["a", "s", "m", "w", "h"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id or row, text, spans) to the figures and the bytes that stay."""
    for batch in batches:
        n_bytes, n_removed, n_spans, digests, kept, spans = [], [], [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or b"") if text.is_valid else b""
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in (marks.as_py() or ())):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            left, at = [], 0
            for lo, hi in merged:
                left.append(raw[at:lo])
                at = hi
            left.append(raw[at:])
            rest = b"".join(left)
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(rest))
            n_spans.append(len(merged))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
            spans.append([{"start": lo, "stop": hi} for lo, hi in merged])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


# ---------------------------------------------------------------- the operator


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts elsewhere in the corpus.

    Returns per row: id_col, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, the bytes that stay) and spans
    (array of start and stop). A null or empty text has no bytes; rows with equal id and text count as two texts and
    get the same result; a null id is kept as null; other columns are not read. An empty table gives no rows.
    """
    out = _deduplicated(docs, F.col(id_col), id_col, text_col, length)
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """The rows of docs, all their columns, with what suffix_dedup leaves of their texts; characters cut in two go.

    Rows of which nothing but white space is left, and something was removed, are dropped. A null text stays null.
    """
    out = _deduplicated(docs, _all_but(docs, text_col), id_col, text_col, length)
    fields = T.StructType([T.StructField("row", out.schema["id"].dataType), T.StructField("left", T.StringType())])
    texts = out.select(F.col("id").alias("row"), "kept", (F.col("n_removed") > 0).alias("cut")).mapInArrow(_decode, fields.add("cut", "boolean"))
    left = F.when(F.col("row.there"), F.col("left")).alias(text_col)
    return texts.where(~F.col("cut") | F.col("left").rlike(r"[^\x20\x09-\x0D]")).select(*[left if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _all_but(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text as one struct, by their places, and whether there is a text."""
    return F.struct(F.col(text_col).isNotNull().alias("there"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column(1)], pa.string()), batch.column(2)], ["row", "left", "cut"])


def _deduplicated(docs: DataFrame, carried: Column, id_col: str, text_col: str, length: int) -> DataFrame:
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("k"), carried.alias("id"), text.alias("text"))
    anchors = materialize(rows.select("k", "text").mapInArrow(_anchors(length), "a long, s long, k long, at long, w int"), "anchors")
    # written, so that the join shuffles it too: Spark splits an anchor of very many rows only between two shuffles
    often = materialize(anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "often")
    met = materialize(anchors.join(often, "a", "left_semi"), "met")
    segments = met.groupBy("a", "s").agg(F.count("*").alias("m"), F.min(F.struct("k", "at", "w")).alias("at"))
    groups = segments.groupBy("a").agg((F.count("*") > INDEX_SEGMENTS).alias("hot"))
    wanted = segments.join(groups, "a").select(F.col("at.k").alias("k"), F.struct("a", "s", "m", "hot", F.col("at.at").alias("at"), F.col("at.w").alias("w")).alias("seg"))
    by_doc = wanted.groupBy("k").agg(F.collect_list("seg").alias("segs"))
    # both joins of rows take the same columns, and both readers of the segments the same sorted rows: one shuffle serves both
    cut = rows.join(by_doc.hint("shuffle_hash"), "k").select("k", "id", "text", "segs").mapInArrow(_cut(length), "g long, a long, s long, m long, bytes binary, hot boolean")
    fetched = cut.repartition("g").sortWithinPartitions("a", "s")
    ranges = "a long, s long, ranges array<struct<lo:int,hi:int>>"
    cold = fetched.mapInArrow(_index(length), ranges)
    windows = fetched.mapInArrow(_windows(length), "a long, s long, m long, w int, h long")
    again = windows.groupBy("a", "h").agg(F.sum("m").alias("c")).where("c > 1").select("a", "h")
    hot = windows.join(again, ["a", "h"]).groupBy("a", "s").agg(F.collect_list(F.struct(F.col("w").alias("lo"), (F.col("w") + 1).alias("hi"))).alias("ranges"))
    marks = cold.unionByName(hot)
    spans = met.join(marks, ["a", "s"]).select("k", F.explode("ranges").alias("r"), "at").select("k", F.struct((F.col("at") + F.col("r.lo")).alias("lo"), (F.col("at") + F.col("r.hi") + length - 1).alias("hi")).alias("span"))
    per_doc = spans.groupBy("k").agg(F.collect_set("span").alias("spans"))
    out = rows.join(per_doc.hint("shuffle_hash"), "k", "left").select("id", "text", "spans")
    fields = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary"), ("spans", "array<struct<start:bigint,stop:bigint>>")]
    schema = T.StructType([T.StructField("id", out.schema["id"].dataType), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    return out.mapInArrow(_remove, schema)
