"""Packing of token sequences by non-negative least squares over length combinations.

Texts are tokenized once. Each gives as many full windows as it holds and one remainder. The histogram of remainders
has fewer bins than the window has tokens, so it is the same size for any corpus: from it the driver enumerates
combinations of two and three lengths that fill a window, solves for how often to use each (least squares, no negative
counts), rounds down to what the histogram has, and packs what is left greedily, longest first. The plan is a table of
patterns. Placing is arithmetic: the n-th remainder of a length takes the n-th slot for that length.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, lower_ascii, materialize, prefix_sums, span_hash, word_spans

#: Lengths that may be the two free parts of a combination of three.
COMMON_LENGTHS = 64
SWEEPS = 40
#: Bytes of words' ids that a worker remembers; then it starts anew.
STORE_BYTES = 16 << 20


# ---------------------------------------------------------------- tokens


_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2


class WordTokenizer:
    """A tokenizers file whose tokens never span white space, with the ids of words met before remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.steps = self.encoder.normalizer, self.encoder.pre_tokenizer
        # words of plain small letters need no normalizing and are one piece each for the file's pattern
        self.short = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = "<|endoftext|>"
        self.mark_id = self.encoder.token_to_id(self.mark)
        self._forget()

    def _forget(self) -> None:
        # sorted hashes of words, and where and how many a word's ids are in the pool
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _held(self) -> int:
        return self.keys.nbytes + self.start.nbytes + self.size.nbytes + self.pool.nbytes

    def _encoded(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Words go through the library together, with a mark between them."""
        if plain:
            self.encoder.normalizer, self.encoder.pre_tokenizer = self.short
            found = self.encoder.encode(" ".join(words), add_special_tokens=False)
            self.encoder.normalizer, self.encoder.pre_tokenizer = self.steps
            return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        if self.mark_id is not None and not any("<|" in w for w in words):
            ids = np.array(self.encoder.encode(self.mark.join(words), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) == len(words) - 1:
                edges = np.concatenate([[-1], cuts, [len(ids)]])
                return np.delete(ids, cuts), np.diff(edges) - 1
        each = [self.encoder.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([x for ids in each for x in ids], np.uint32), np.array([len(x) for x in each], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        kinds: list[list[int]] = [[], [], []]
        for i, w in enumerate(words):
            plain = w.isalpha() and w.islower() and (w.isascii() or (max(w) < "\u0250" and unicodedata.is_normalized("NFC", w)))
            kinds[0 if plain else 2 if "<|" in w else 1].append(i)
        parts = [(k == 0, x[at : at + n]) for k, x in enumerate(kinds) for n in [1 if k == 2 else 2000] for at in range(0, len(x), n)]
        pool, sizes = [self.pool], []
        for plain, part in parts:
            ids, size = self._encoded([words[i] for i in part], plain)
            pool.append(ids)
            sizes.append(size)
        size = np.concatenate(sizes)
        keys = np.concatenate([self.keys, hashes[[i for _, part in parts for i in part]]])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])[order]
        self.size = np.concatenate([self.size, size.astype(np.int32)])[order]
        self.pool = np.concatenate(pool)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in buf, and the n + 1 offsets of each text's ids."""
        raw = buf.tobytes()
        cuts = None
        if b"<|" not in raw:  # a letter next to a mark other than ' always ends a piece of the file's pattern
            buf = lower_ascii(buf)
            raw = buf.tobytes()
            kind = _KINDS[buf]
            cuts = np.zeros(len(buf), bool)
            cuts[1:] = kind[1:] * kind[:-1] == 2
        s, e, doc = word_spans(buf, bounds, cuts=cuts)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        h = span_hash(prefix_sums(buf), s, e)
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._find(uniq)
        if not known.all():
            if self._held() > STORE_BYTES:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self._learn(uniq[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
            at, _ = self._find(uniq)
        slot = at[back]
        each = self.size[slot].astype(np.int64)
        ends = np.cumsum(each)
        ids = self.pool[np.repeat(self.start[slot] - (ends - each), each) + np.arange(ends[-1])]
        upto = np.searchsorted(doc, np.arange(len(bounds)))
        return ids, np.concatenate([[0], ends])[upto]


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for a worker, whose memory of words serves one task after another."""
    return WordTokenizer(path)


def _tokenize(path: str, window: int, end_id: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        fulls = 0
        for batch in batches:
            buf, off = byte_column(batch.column(1))
            for i, j in doc_chunks(off):
                ids, at = encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                total, rank, full_at, sums, kept = [], [], [], [], []
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    rest = n % window
                    total.append(n)
                    rank.append(int(seen[rest]))
                    seen[rest] += 1
                    full_at.append(fulls)
                    fulls += n // window
                    sums.append([zlib.crc32(own[x : x + window].tobytes()) for x in range(0, n, window)])
                    if keep:
                        kept.append(own.tobytes())
                cols = [batch.column(0).slice(i, j - i), pa.array([task] * (j - i), pa.int32()), pa.array(total, pa.int64()), pa.array([x % window for x in total], pa.int32()), pa.array(rank, pa.int64()), pa.array(full_at, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
                names = ["id", "task", "tokens", "rest", "rank", "full_at", "sums"]
                if keep:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


# ---------------------------------------------------------------- the plan


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill the window, and triples of which two parts are among the commonest lengths."""
    found = {(a, window - a) for a in range((window + 1) // 2, window) if hist[a] and hist[window - a]}
    common = [int(x) for x in np.argsort(-hist, kind="stable")[:COMMON_LENGTHS] if hist[x]]
    for x, a in enumerate(common):
        for b in common[x:]:
            c = window - a - b
            if c > 0 and hist[c]:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def nnls_counts(combos: list[tuple[int, ...]], hist: np.ndarray) -> np.ndarray:
    """Non-negative x that brings the combinations' lengths, x times each, nearest to the histogram; by coordinates."""
    rest = hist.astype(float).copy()
    x = [0.0] * len(combos)
    weights = []
    for c in combos:
        parts: dict[int, int] = {}
        for a in c:
            parts[a] = parts.get(a, 0) + 1
        weights.append((list(parts.items()), float(sum(v * v for v in parts.values()))))
    rest_list = rest.tolist()
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (parts, norm) in enumerate(weights):
            step = sum(v * rest_list[a] for a, v in parts) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, v in parts:
                    rest_list[a] -= v * step
        if moved < 0.01:
            break
    return np.array(x)


def plan_patterns(hist: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) patterns that use every remainder of the histogram exactly once."""
    left = hist.astype(np.int64).copy()
    combos = combinations(left, window)
    out: list[tuple[int, tuple[int, ...]]] = []
    counts = np.floor(nnls_counts(combos, left) + 1e-9).astype(np.int64)
    for j in np.argsort(-counts, kind="stable"):
        c = combos[j]
        n = min([int(counts[j]), *(int(left[a]) // c.count(a) for a in set(c))])
        if n > 0:
            for a in c:
                left[a] -= n
            out.append((n, c))
    while (some := np.flatnonzero(left)).size:
        room, c, use = window, [], {}
        while True:
            fit = some[: np.searchsorted(some, room, side="right")]
            a = next((int(a) for a in fit[::-1] if left[a] > use.get(int(a), 0)), 0)
            if not a:
                break
            c.append(a)
            use[a] = use.get(a, 0) + 1
            room -= a
        n = min(int(left[a]) // k for a, k in use.items())
        for a in c:
            left[a] -= n
        out.append((n, tuple(c)))
    return out


class Placement:
    """For each length, the slots of the plan in order: from which rank, first sequence and offset."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]], window: int):
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
        upto = [0] * window
        base = 0
        for times, lengths in patterns:
            at = 0
            for a in lengths:
                slots[a].append((upto[a], base, at))
                upto[a] += times
                at += a
            base += times
        self.sequences = base
        self.by_length = [tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) if s else None for s in slots]

    def __call__(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, base, at = self.by_length[length]
        j = np.searchsorted(first, ranks, side="right") - 1
        return base[j] + ranks - first[j], at[j]


def _place(place: Placement, window: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rest, rank, full_at = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            off = batch.column(5).offsets.to_numpy()
            sums = batch.column(5).values.to_numpy()
            pieces = off[1:] - off[:-1]
            row = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * window
            length = np.minimum(tokens[row] - start, window)
            seq = place.sequences + full_at[row] + nth
            offset = np.zeros(len(row), np.int64)
            last = np.flatnonzero(length < window)
            for a in np.unique(length[last]):
                at = last[length[last] == a]
                seq[at], offset[at] = place(int(a), rank[row[at]])
            cols = [batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, sums[off[0] : off[-1]], tokens[row], seq, offset))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep:
                whole = batch.column(6)
                cols.append(pa.array([np.frombuffer(whole[int(r)].as_buffer(), "<u4")[s : s + n].astype(np.int32) for r, s, n in zip(row, start, length, strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


# ---------------------------------------------------------------- the operator


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize texts, end each with end_id, and lay the ids out in sequences of at most `window` tokens.

    Returns a row per piece: id_col, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32 bit),
    doc_tokens, sequence_id (from 0, gapless), offset in the sequence, and with keep_ids the ids themselves. A text of n
    tokens gives n // window full pieces and one of the rest. A null or empty text has end_id alone. Equal rows are
    packed as often as they come; ids may be null; other columns are not read. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = ", ids binary" if keep_ids else ""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    tokens = materialize(rows.mapInArrow(_tokenize(tokenizer, window, end_id, keep_ids), f"id {id_type}, task int, tokens long, rest int, rank long, full_at long, sums array<long>{extra}"), "tokens")
    counts = tokens.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"tokens div {window}")).alias("fulls"))
    # at most `window` rows, whatever the corpus
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).where("rest > 0").collect():
        hist[r["rest"]] = r["n"]
    place = Placement(plan_patterns(hist, window), window)
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    per_task = counts.groupBy("task").agg(F.sum("fulls").alias("fulls"))
    # one row for each task of the tokenizing job
    full_before = per_task.select("task", F.coalesce(F.sum("fulls").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_before"))
    placed = tokens.join(ranks.join(full_before, "task"), ["task", "rest"])
    placed = placed.select("id", "tokens", "rest", (F.col("rank") + F.col("before")).alias("rank"), (F.col("full_at") + F.col("full_before")).alias("full_at"), "sums", *(["ids"] if keep_ids else []))
    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return placed.mapInArrow(_place(place, window, keep_ids), schema).withColumnRenamed("id", id_col)
