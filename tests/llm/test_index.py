"""Ranked search, token files and spelling variants against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import ranked_search, spelling, token_file
from tidelake.llm.common import byte_column

from ..conftest import SF
from .conftest import lower

PATH = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- ranked search


def terms(text):
    return TERM.findall(lower(text))


def ranked(docs, items, k):
    """(item, rank, id, score) by the contract's formulas."""
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            n, score = sum(bag.values()), 0
            for t in set(terms(text)):
                if bag[t]:
                    m = 100 - 50 + (50 * n * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=str)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, rank string, score string, q int")


@pytest.mark.parametrize("slice_bytes, bits", [(1 << 21, 12), (3000, 12), (2000, 1)])
def test_ranked_search_brute_force(spark, monkeypatch, slice_bytes, bits):
    """Ties, repeated rows, null ids and texts; small slices; signatures so full that bounds are poor."""
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(ranked_search, "BITS", bits)
    rng = random.Random(slice_bytes + bits)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "Straße", "x'y"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))) for i in range(150)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (501, docs[3][1]), (None, docs[4][1]), (None, docs[4][1]), (7, None), (8, ""), (9, " ,. "), (10, "w1 " * 3000), (-4, docs[5][1])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12))), None, None, 0) for i in range(12)] + [(20, None, None, None, 0), (21, "nowhere", None, None, 0), (22, "W1 w1, É", None, None, 0), (22, "W1 w1, É", None, None, 0), (None, "w2", None, None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ranked_search.ranked_search(d, asked(spark, items), k=7).collect()), key=str)
    assert got == ranked(docs, [x[:2] for x in items], 7)


def test_ranked_search_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_BYTES", 20)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i % 4} b{i % 6}", None, None, 0) for i in range(9)]
    got = sorted((tuple(r) for r in ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), asked(spark, items), k=5).collect()), key=str)
    assert got == ranked(docs, [x[:2] for x in items], 5)


def test_ranked_search_odd(spark, odd_docs, no_docs):
    items = asked(spark, [(1, "alpha beta one", None, None, 0)])
    got = sorted((tuple(r) for r in ranked_search.ranked_search(odd_docs, items).collect()), key=str)
    assert got == ranked([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [(1, "alpha beta one")], 50)
    assert ranked_search.ranked_search(no_docs, items).count() == 0
    assert ranked_search.ranked_search(odd_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.ranked_search(odd_docs, items.limit(0)).count() == 0


def test_signature_never_tells_too_low_a_count():
    """Bounds are no lower than scores, and exclude most documents of other words."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(5, 300))) for _ in range(300)]
    buf, off = byte_column(pa.array(texts))
    row = ranked_search.index_slice(buf, off, pa.array(range(300)))
    queries = ranked_search.Queries.of_texts([f"w{i} w{i * 7} w1 w2" for i in range(3, 40)])
    reader = ranked_search.SliceReader(row, queries, np.full(len(queries.terms), 5, np.int64), row["with_terms"], row["terms"])
    bounds, exact = reader.bounds(), reader.scores(np.arange(300))
    assert (bounds >= exact).all() and bounds.sum() < 1.3 * exact.sum()


def test_many_short_documents_and_queries_in_bounded_memory():
    """A slice of thousands of short documents meets a thousand queries in blocks; whole matrices would take 200 MB."""
    import tracemalloc

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(6000)]
    buf, off = byte_column(pa.array([" ".join(rng.choices(vocabulary, k=8)) for _ in range(4000)]))
    row = ranked_search.index_slice(buf, off, pa.array(range(4000)))
    queries = ranked_search.Queries.of_texts([" ".join(rng.choices(vocabulary, k=8)) for _ in range(999)] + [None])
    weights, floor = np.arange(1, len(queries.terms) + 1), np.ones(1000, np.int64)
    exact = ranked_search.SliceReader(row, queries, weights, row["with_terms"], row["terms"]).scores(np.arange(4000))
    docs = np.frombuffer(row["docs"], "<i8")
    want = []
    for q in range(1000):
        best = sorted((-exact[q, i], docs[i]) for i in np.flatnonzero(exact[q]))[:5]
        want += [(q, d, -s) for s, d in best]
    schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in ranked_search._SLICE.split(", ")])
    index = pa.RecordBatch.from_pylist([row], schema=schema)
    for tried in (3, None):
        tracemalloc.start()
        try:
            (got,) = ranked_search._search(queries, weights, row["with_terms"], row["terms"], 5, floor, tried)(iter([index]))
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        rows = [tuple(r.values()) for r in got.to_pylist()]
        assert rows == want if tried is None else set(rows) <= {(q, docs[i], exact[q, i]) for q, i in zip(*np.nonzero(exact), strict=True)}
        assert most < 64 << 20


# ---------------------------------------------------------------- token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**64 - 1), st.integers(2**60 - 2, 2**60 + 2)), max_size=400), st.integers(1, 97))
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, np.uint64)
    blocks = token_file.encode_blocks(ids, block)
    back = [token_file.decode_words(w, min(block, len(ids) - block * i)) for i, w in enumerate(blocks)]
    assert np.array_equal(np.concatenate(back) if back else np.zeros(0, np.uint64), ids)
    for w in blocks:  # a word holds as many ids as fit
        assert len(w) <= 2 * block


def test_simple8b_packs_by_width():
    assert [len(token_file.encode_blocks(np.full(840, x, np.uint64), 840)[0]) for x in (1, 3, 7, 255, 1023, 50_000, 2**59, 2**63)] == [14, 28, 42, 120, 140, 280, 840, 1680]


@pytest.mark.parametrize("slots", [1 << 20, 1 << 6])
def test_piece_tokenizer_equals_library(monkeypatch, spark, slots):
    """Also where pieces contend for few slots and are forgotten each time."""
    monkeypatch.setattr(token_file, "SLOTS", slots)
    rng = random.Random(slots)
    marks = "ab1 '\n\t.,é 　日<|x s'\x85\x1c "
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    texts += ["x <|endoftext|> y", "a<|endoftext|>b", "don't I'LL 're,'s  \n\n foo\n\n\nbar  x", "é é  é\tq", "", "  ", " a  b\t c\r\n d", "日本語 テスト です。 中文", "𝔘𝔫𝔦 ⅷ ²x"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    buf, off = byte_column(pa.array(texts))
    encode, library = token_file.PieceTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, at = encode(buf, off - off[0])
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        token_file.PieceTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("file_bytes, block", [(32 << 20, 8192), (4000, 100)])
def test_token_files(spark, tmp_path, monkeypatch, odd_docs, file_bytes, block):
    """Written and read back: starts in order of ids, nulls first, whole ids, one id with many rows, parts of documents."""
    monkeypatch.setattr(token_file, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(token_file, "BLOCK_IDS", block)
    hot = spark.createDataFrame([(3, f"hot {i % 7} " * 40) for i in range(60)], "doc_id long, text string")
    d = odd_docs.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("h")).unionByName(hot, allowMissingColumns=True)
    path = f"{tmp_path}/files"
    token_file.write_token_files(d, PATH, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in token_file.read_token_files(spark, path, keep_ids=True).collect())
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for r in d.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[(r["doc_id"], len(ids) // 4, zlib.crc32(ids), ids)] += 1
    assert collections.Counter(x[1:] for x in got) == want
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
    order = [(x[1] is not None, x[1] or 0) for x in got]
    assert order == sorted(order)


def test_token_files_of_nothing(spark, no_docs):
    assert token_file.token_file_digest(no_docs, PATH).count() == 0


def test_token_file_that_is_damaged():
    words = token_file.encode_blocks(np.arange(10, dtype=np.uint64))[0]
    block = token_file.block_bytes(0, 0, [(5, 10, False)], words) + token_file.END.encode()
    assert [(n, b, p, i.tolist()) for n, b, p, i in token_file.file_blocks(block)] == [(0, 0, [(5, 10, False)], list(range(10)))]
    with pytest.raises(ValueError):
        list(token_file.file_blocks(block[8:]))
    with pytest.raises(ValueError):
        list(token_file.file_blocks(block[:-8] + b"12345678"))


# ---------------------------------------------------------------- spelling


def variants(docs, least=7):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= least
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: {v for v in words if v != w and one_edit(w, v)} for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", [0, 1])
def test_spelling_brute_force(spark, seed):
    """Few letters, so that neighbours, runs of one letter and ties are common; chains of forms; nulls and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(150)]
    docs = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)]
    docs += [(100 + i, "Colourful " * 400) for i in range(3)] + [(200, "colourfull " * 30 + "colourfulll " * 3 + "×÷ÀÿÆæøß " * 3 + "Aaaaaaaa aaaaaaaaa aaaaaaaaaa " * 5), (None, "nullable nullable"), (None, None), (5, ""), (6, "x" * 300 + " " + "x" * 299 + " " + "x" * 300 + " " + "x" * 299)]
    docs += docs[:2]
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted(tuple(r) for r in spelling.spelling_variants(d).collect())
    assert got == variants(docs)
    assert sum(1 for r in got if r[1] and r[2] != r[1]) >= 1 or seed


def test_spelling_of_nothing(spark, odd_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    assert sorted(tuple(r) for r in spelling.spelling_variants(odd_docs).collect()) == variants([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_crc_of_runs():
    rng = random.Random(1)
    runs = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 63, 64, 65, 500]))) for _ in range(200)]
    ends = np.cumsum([len(r) for r in runs])
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], np.uint32)
    got = spelling.crc_of_runs(np.frombuffer(b"".join(runs), np.uint8), ends - [len(r) for r in runs], ends, state)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + r) for i, r in enumerate(runs)]
