"""Spelling variants of a corpus's words by permuterm rotations.

A word is closed by a terminator and rotated. The rotation that begins behind a character p ends with that character, so
words that differ in p alone share all of it but the end: they are a prefix range of the sorted rotations. A word that
lacks p has a rotation that is this prefix and nothing else. Sorted rotations are therefore scanned once: each group of
one prefix holds words that are replacements of each other, and at most one word of which they are insertions. A pair
differs by a replacement in one group only; an insertion into a run of one character counts at the run's start only, so
no pair is met twice. A group has a word for each character at most, so none is large; its words are sent figures of
their neighbours, not pairs. Words are spread by prefix, and no word's share grows with the corpus.

A word of n code points has about 2 n rotations of n code points; they are made and sent row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, lower_ascii, materialize, word_spans

TERMINATOR = "$"
#: A word's code points, occurrences of a word, how much commoner a form is, and which hashes lose a code point.
LEAST_LENGTH, LEAST_COUNT, COMMONER, SLIP = 7, 2, 10, 31
#: Bytes up to which runs are hashed together.
SHORT = 64

_GAP = np.zeros(256, bool)
_GAP[0] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
_CRC = (_CRC ^ _CRC[0]).astype(np.uint32)


# ---------------------------------------------------------------- words


def crc_of_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, carried on from the crc32 that is its state. All short runs advance together."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    length = end - start
    order = np.argsort(-length, kind="stable")
    order = order[length[order] <= SHORT]
    live = np.searchsorted(-length[order], -np.arange(1, SHORT + 1), side="right")  # runs of at least j bytes
    for j in range(SHORT):
        if not live[j]:
            break
        runs = order[: live[j]]
        now = out[runs]
        out[runs] = _CRC[(now ^ buf[start[runs] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(buf[start[i] : end[i]], int(state[i]))
    return out


def word_counts(buf: np.ndarray, bounds: np.ndarray, ids: list, least: int) -> tuple[pa.Array, pa.Array]:
    """Different words of texts that lie one after the other in buf, and how often each occurs."""
    letter = _LETTER[buf]
    letter[1:] |= buf[:-1] == 0xC3
    marks = letter.astype(np.uint8)
    s, e, doc = word_spans(marks, bounds, space=_GAP)
    wide = np.concatenate([[0], np.cumsum(buf == 0xC3)])
    points = e - s - (wide[e] - wide[s])
    some = np.flatnonzero(points >= least)
    s, e, doc, points = s[some], e[some], doc[some], points[some]
    low = lower_ascii(buf)
    state = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids], np.uint32)
    h = crc_of_runs(low, s, e, state[doc])
    slips = h % np.uint32(SLIP) == 0
    changed = []
    for i in np.flatnonzero(slips & (points > least)).tolist():
        run = low[s[i] : e[i]].tobytes().decode()
        at = int(h[i]) % len(run)
        changed.append(run[:at] + run[at + 1 :])
    s, e = s[~slips], e[~slips]
    ends = np.cumsum(e - s)
    each = np.repeat(s - (ends - (e - s)), e - s) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[each]))])
    counts = pc.value_counts(pa.concat_arrays([plain, pa.array(changed, pa.large_string())]))
    return counts.field(0), counts.field(1)


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = byte_column(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in doc_chunks(off, 4 << 20):
                words, n = word_counts(buf[off[i] : off[j]], off[i : j + 1] - off[i], ids[i:j], least)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), n.cast(pa.int64())], ["word", "n"])

    return run


# ---------------------------------------------------------------- rotations


def rotations(words: DataFrame) -> DataFrame:
    """(key, char, lead, n): for each character its word's rotation that begins behind it, without it, and for each
    whole rotation the same with no character. lead: the character begins a run of itself."""
    at, size = F.col("at"), F.length("word")
    part = lambda start, n: F.substring(F.col("word"), start, n)
    without = words.select("word", "n", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    char = part(at, F.lit(1))
    skipped = without.select(F.concat(part(at + 1, size), F.lit(TERMINATOR), part(F.lit(1), at - 1)).alias("key"), char.alias("char"), ((at == 1) | (part(at - 1, F.lit(1)) != char)).alias("lead"), "n")
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    turned = whole.select(F.concat(part(at + 1, size), F.lit(TERMINATOR), part(F.lit(1), at)).alias("key"), F.lit("").alias("char"), F.lit(False).alias("lead"), "n")
    return skipped.unionByName(turned)


def group_neighbours(key: str, members: list[tuple[str, bool, int]]) -> list[tuple[str, int, int, str]]:
    """(word, near words, occurrences of the commonest of them, that word) for each member (char, lead, n) of a prefix's group."""
    tail, head = key.split(TERMINATOR)
    shared = [(-n, head + c + tail, c, lead) for c, lead, n in members]
    shared.sort()
    skips = sum(1 for x in shared if x[2])
    leads = sum(1 for x in shared if x[3])
    out = []
    for me in shared:
        if me[2]:
            near = skips - 1 + (me[3] and skips < len(shared))
            best = next((x for x in shared if x is not me and (x[2] or me[3])), None)
        else:
            near, best = leads, next((x for x in shared if x[3]), None)
        if near:
            out.append((me[1], near, -best[0], best[1]))
    return out


_NEAR = "word string, near long, best_n long, best string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sorted rotations; the last group of a batch waits for the next batch."""
    carried: pa.Table | None = None

    def found(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(edges)
        several = np.flatnonzero(size > 1)
        rows = table.take(pa.array(np.repeat(edges[several] - (np.cumsum(size[several]) - size[several]), size[several]) + np.arange(size[several].sum())))
        keys, members = rows["key"].to_pylist(), list(zip(rows["char"].to_pylist(), rows["lead"].to_pylist(), rows["n"].to_pylist(), strict=True))
        out, at = [], 0
        for n in size[several].tolist():
            out += group_neighbours(keys[at], members[at : at + n])
            at += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate([pa.string(), pa.int64(), pa.int64(), pa.string()])], ["word", "near", "best_n", "best"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carried is not None:
            table = pa.concat_tables([carried, table])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        keys = table["key"]
        differs = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(differs) + 1])
        yield from found(table, starts)
        carried = table.slice(starts[-1])
    if carried is not None:
        yield from found(carried, np.array([0, carried.num_rows]))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, commoner: int = COMMONER) -> DataFrame:
    """Words of the corpus with their commonest near word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case, of at least least_length code
    points and least_count occurrences; a run whose crc32 of `<id>:<run>` is divisible by 31 loses a code point first.
    Words are near if one inserted, deleted or replaced code point leads from one to the other. form is the near word of
    most occurrences (ties: the smallest) if those are at least `commoner` times the word's, else null; root is what
    following forms ends at, the word itself if it has none. A null text has no words, a null id counts as empty text,
    repeated rows count each time, other columns are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count(least_length), "word string, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")
    near = rotations(words).repartition("key").sortWithinPartitions("key").mapInArrow(_scan, _NEAR)
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("form"))).alias("best"))
    form_n = -F.col("best.n")
    chosen = form_n >= commoner * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, form_n).alias("form_n"))
    formed = materialize(formed, "forms")
    roots = final_forms(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def final_forms(links: DataFrame) -> DataFrame:
    """(word, root): where each chain ends. A round doubles the steps taken; each form is commoner than its word, so
    chains are short and end."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(links.join(ahead, "root", "left"), "roots")
        if stepped.where("next is not null").isEmpty():
            return stepped.select("word", "root")
        links = stepped.select("word", F.coalesce("next", "root").alias("root"))
