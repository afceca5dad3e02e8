"""Quality rules with an n-gram perplexity band for each language.

A modified Kneser-Ney model over the bytes of words (each word with a space in front and behind) is counted by Spark
over all texts, by language. Its probabilities are stored in sorted hash arrays. An n-gram's key keeps 24 bits of hash,
so an array has at most 2**24 entries however large the corpus is, and its broadcast is bounded by that. Each text has
two perplexities, by byte and by word, as marks tacked to words cost little by byte and much by word. They are compared
with the medians of the text's language: texts too far above are not the language, texts too far below repeat
themselves. How far is measured by the language's own spread, so a language's bulk is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, materialize, mix64, prefix_sums, span_hash, word_spans

ORDER = 4
HASH_BITS = 24
#: For the two perplexities: least spread, and how many spreads (from the quartiles, as those of a normal curve) a text
#: may be away from its language's median.
BANDS = {"bits_per_byte": (0.01, 4.0), "bits_per_word": (0.05, 4.0)}
#: Bytes of text at which chance doubles the spread's square.
SHORT = 400.0
MIN_WORDS = 50
_FLUSH = 400_000


# ---------------------------------------------------------------- counts of the rules


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def rule_counts(buf: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Words, their code points, symbols, repeated lines, and words in windows of three that the text has twice."""
    n = len(bounds) - 1
    s, e, doc = word_spans(buf, bounds)
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    sums = prefix_sums(buf)
    words = np.bincount(doc, minlength=n)
    chars = np.bincount(doc, starts[e] - starts[s], n).astype(np.int64)
    marks = symbols[bounds[1:]] - symbols[bounds[:-1]]
    # lines
    newline = np.flatnonzero(buf == 10)
    ls = np.unique(np.concatenate([bounds[:-1], newline + 1]))
    ls = ls[ls < len(buf)]
    ends = np.append(newline, len(buf))
    le = np.minimum(ends[np.searchsorted(ends, ls)], bounds[np.searchsorted(bounds, ls, side="right")])
    upto = np.searchsorted(s, np.concatenate([ls, le])).reshape(2, -1) if len(ls) else np.zeros((2, 0), np.int64)
    filled = upto[1] > upto[0]
    ls, le = ls[filled], le[filled]
    line_doc = np.searchsorted(bounds, ls, side="right") - 1
    dup = np.bincount(line_doc[_later(line_doc, span_hash(sums, ls, le))], minlength=n)
    # windows of three words
    repeat = np.zeros(n, np.int64)
    if len(s) > 2:
        w = span_hash(sums, s, e)
        tri = mix64(mix64(w[:-2] * np.uint64(3) + w[1:-1]) * np.uint64(3) + w[2:])
        ok = np.flatnonzero(doc[2:] == doc[:-2])
        twice = ok[_shared(doc[ok], tri[ok])]
        hit = np.zeros(len(s), bool)
        for j in range(3):
            hit[twice + j] = True
        repeat = np.bincount(doc[hit], minlength=n)
    return [words, chars, marks, dup, repeat]


def _later(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions whose key an earlier position of the group has."""
    order = np.lexsort((np.arange(len(key)), key, group))
    g, k = group[order], key[order]
    same = np.zeros(len(key), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    return order[same]


def _shared(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions whose key another position of the group has."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    flag = np.zeros(len(key), bool)
    flag[1:] |= same
    flag[:-1] |= same
    return order[flag]


# ---------------------------------------------------------------- the model's n-grams


def word_stream(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with white space as one space, one more in front of each text, and each byte's text number."""
    s, e, doc = word_spans(buf, bounds)
    if not len(s):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    first = np.ones(len(s), bool)
    first[1:] = doc[1:] != doc[:-1]
    size = e - s + 1 + first
    end = np.cumsum(size)
    out = np.full(end[-1], 32, np.uint8)
    at = np.arange(int((e - s).sum()))
    lead = np.cumsum(e - s) - (e - s)
    word = np.repeat(np.arange(len(s)), e - s)
    out[(end - size + first)[word] + at - lead[word]] = buf[s[word] + at - lead[word]]
    return out, np.repeat(doc, size)


def codes(stream: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each byte, it and the three before it in its text (0 where there are none) as one number."""
    c = stream.astype(np.uint32)
    out = c.copy()
    for k in range(1, ORDER):
        prev = np.zeros(len(c), np.uint32)
        prev[k:] = np.where(which[k:] == which[:-k], c[:-k], 0)
        out |= prev << np.uint32(8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) with counts added up within the task."""
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        uniq, back = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(back, np.concatenate([n for _, n in parts]), len(uniq)).astype(np.int64)

    def out(lang, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    for batch in batches:
        langs = np.array([x if x is None else str(x) for x in batch.column(0).to_pylist()], object)
        buf, off = byte_column(batch.column(1))
        for i, j in doc_chunks(off):
            stream, which = word_stream(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            if not len(stream):
                continue
            code = codes(stream, which)
            own = langs[i:j]
            names = list(dict.fromkeys(own))
            number = np.array([names.index(x) for x in own])[which]
            for k, lang in enumerate(names):
                keys, n = np.unique(code[number == k], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, n))
                if len(parts) > 16:
                    parts[:] = [merged(parts)]
                    if len(parts[0][0]) > _FLUSH:
                        yield out(lang, *parts[0])
                        del held[lang]
    for lang, parts in held.items():
        if parts:
            yield out(lang, *merged(parts))


def gram_hash(lang: int, code: np.ndarray) -> np.ndarray:
    return (mix64(code.astype(np.uint64) + (np.uint64(lang + 1) << np.uint64(33))) >> np.uint64(64 - HASH_BITS)).astype(np.uint32)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / max(a, 1), 0.1), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, code, p): interpolated modified Kneser-Ney probability of each n-gram's last byte, from (lang, code, n).

    Lower orders count how many different bytes stand in front. All steps are joins and grouped sums.
    """
    level = materialize(counts, "grams")
    tables = [level]
    for k in range(ORDER - 1, 0, -1):
        low = F.col("code").bitwiseAND((1 << (8 * k)) - 1)
        tables.append(tables[-1].groupBy("lang", low.alias("code")).agg(F.count("*").alias("n")))
    p = None
    for k, t in enumerate(reversed(tables), 1):
        last = F.col("code").bitwiseAND((1 << (8 * (k - 1))) - 1)  # the lower order's code
        context = F.shiftright("code", 8)
        bins = t.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # one row for each language
        d = {r["lang"]: _discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in bins}
        spark = t.sparkSession
        rates = F.broadcast(spark.createDataFrame([(x, *v) for x, v in d.items()], "lang string, d1 double, d2 double, d3 double"))
        named = t.join(rates, t["lang"].eqNullSafe(rates["lang"])).drop(rates["lang"])
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        named = named.select("lang", "code", context.alias("context"), last.alias("low"), "n", cut.alias("cut"))
        sums = named.groupBy(F.col("lang").alias("l"), F.col("context").alias("c")).agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        joined = named.join(sums, (named["lang"].eqNullSafe(sums["l"])) & (named["context"] == sums["c"]))
        if p is None:
            below = joined.withColumn("q", F.lit(1 / 256))
        else:
            q = p.select(F.col("lang").alias("ql"), F.col("code").alias("qc"), F.col("p").alias("q"))
            below = joined.join(q, (joined["lang"].eqNullSafe(q["ql"])) & (joined["low"] == q["qc"]))
        p = materialize(below.select("lang", "code", ((F.col("n") - F.col("cut") + F.col("mass") * F.col("q")) / F.col("total")).alias("p")), "kn")
    return p


class HashedModel:
    """Sorted 24-bit hashes of n-grams and their log2 probabilities; n-grams that share a hash share their mean."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray, langs: list):
        order = np.argsort(hashes)
        self.hashes, self.logs, self.langs = hashes[order].astype(np.uint32), logs[order].astype(np.float32), {x: i for i, x in enumerate(langs)}

    def bits(self, lang, code: np.ndarray) -> np.ndarray:
        """Information of each n-gram; all n-grams of the corpus are known."""
        h = gram_hash(self.langs.get(lang, -1), code)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, -self.logs[at], 16.0)


def _hash_rows(langs: dict):
    def run(batches):
        for b in batches:
            lang = np.array([langs[x] for x in b.column(0).to_pylist()], np.int64)
            code = b.column(1).to_numpy().astype(np.uint64)
            h = np.zeros(len(code), np.int64)
            for k in np.unique(lang):
                h[lang == k] = gram_hash(int(k), code[lang == k])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.log2(b.column(2).to_numpy()))], ["h", "log"])

    return run


def _measure(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: HashedModel = model.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            buf, off = byte_column(batch.column(2))
            cols = [np.zeros(batch.num_rows, np.int64) for _ in range(6)]
            bits = np.zeros(batch.num_rows)
            for i, j in doc_chunks(off):
                part, bounds = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                for col, v in zip(cols, rule_counts(part, bounds), strict=False):
                    col[i:j] = v
                stream, which = word_stream(part, bounds)
                if not len(stream):
                    continue
                code = codes(stream, which)
                own = langs[i:j]
                names = list(dict.fromkeys(own))
                number = np.array([names.index(x) for x in own])[which]
                info = np.zeros(len(code))
                for k, lang in enumerate(names):
                    info[number == k] = m.bits(lang, code[number == k])
                bits[i:j] = np.bincount(which, info, j - i)
                cols[5][i:j] = np.bincount(which, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols), pa.array(bits)], ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n", "bits"])

    return run


# ---------------------------------------------------------------- the operator


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Count the rules' figures on every whole text, and reject texts outside their language's perplexity band.

    Returns per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50
    words, or more than half of them in repeated windows), kept, bits_per_byte and bits_per_word (null without words),
    and the row's band of either (_lower, _upper). A null or empty text has no words and fails. A null language is one of its own. Equal rows count
    and are judged as often as they come; other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    model = kneser_ney(counts)
    langs = sorted({r["lang"] for r in model.select("lang").distinct().collect()}, key=lambda x: (x is None, x))  # languages only
    hashed = model.mapInArrow(_hash_rows({x: i for i, x in enumerate(langs)}), "h long, log double").groupBy("h").agg(F.avg("log").alias("log"))
    table = hashed.toArrow()  # at most 2**HASH_BITS rows
    arrays = HashedModel(table["h"].to_numpy(), table["log"].to_numpy(), langs) if table.num_rows else HashedModel(np.zeros(1, np.int64), np.zeros(1), langs)
    schema = f"id {id_type}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n long, bits double"
    measured = materialize(rows.mapInArrow(_measure(spark.sparkContext.broadcast(arrays)), schema), "measured")
    per_byte, per_word = F.when(F.col("n") > 0, F.col("bits") / F.col("n")), F.when(F.col("n_words") > 0, F.col("bits") / F.col("n_words"))
    measured = measured.withColumns({"bits_per_byte": per_byte, "bits_per_word": per_word})
    long_enough = measured.where(F.col("n_words") >= MIN_WORDS)
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000).alias(f"q_{c}")
    bands = long_enough.groupBy(F.col("lang").alias("l")).agg(*[quartiles(c) for c in BANDS])
    # one row for each language
    judged = measured.join(F.broadcast(bands), measured["lang"].eqNullSafe(F.col("l")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside, edges = F.lit(True), []
    for c, (least, rate) in BANDS.items():
        q = F.col(f"q_{c}")
        room = rate * F.greatest((q[2] - q[0]) / 1.349, F.lit(least)) * F.sqrt(1 + F.lit(SHORT) / F.greatest("n", F.lit(1)))
        lower, upper = q[1] - room, q[1] + room
        inside = inside & F.coalesce((F.col(c) >= lower) & (F.col(c) <= upper), F.lit(True))
        edges += [F.col(c), lower.alias(f"{c}_lower"), upper.alias(f"{c}_upper")]
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), *edges)
