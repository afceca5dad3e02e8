"""Packing, search, records, mixing and the whole pipeline."""

import collections
import importlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from ..conftest import SF, rows_of, rows_of_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm.mixing import by_inversion, hypergeometric, mix_sources, mixed_documents, split_tree, water_fill
from tidelake.llm.packing import Placement, WordTokenizer, pack_documents, plan_patterns
from tidelake.llm.queries import ORACLES, QUERIES
from tidelake.llm.revisits import canonical_url, resolve_revisits
from tidelake.llm.topk_search import topk_search

from .conftest import words
from .test_dedup import linked

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("store", [16 << 20, 0])
def test_word_tokenizer_equals_library(spark, monkeypatch, store):
    """Also where the store of words is full each time, and stays within its bound."""
    import pyarrow as pa

    from tidelake.llm import packing
    from tidelake.llm.common import byte_column

    monkeypatch.setattr(packing, "STORE_BYTES", store)

    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()]
    texts += ["x <|endoftext|> y", "a<|startoftext|>b İstanbul ΣΑΣ", "é é ́x", " a b\x0bc\x1cd 1234 don't I'LL", "don,'t a_b x=y É,é A.B-C I'm,\"re's foo—,bar ,'s İ! a1,2b ß ŉ.", "", "  "]
    buf, off = byte_column(pa.array(texts))
    encode, library = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from memory
        ids, at = encode(buf, off - off[0])
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 40), max_size=40))
def test_plan_uses_each_remainder_once(counts):
    hist = np.zeros(64, np.int64)
    for k, v in counts.items():
        hist[k] = v
    patterns = plan_patterns(hist, 64)
    used = collections.Counter()
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 64
        for a in lengths:
            used[a] += n
    assert used == collections.Counter({k: int(v) for k, v in enumerate(hist) if v})
    place = Placement(patterns, 64)
    spots = [(int(s), int(o), a) for a in range(64) if hist[a] for s, o in zip(*place(a, np.arange(hist[a])), strict=True)]
    assert len(spots) == len(set(spots)) and {s for s, _, _ in spots} == set(range(place.sequences))


def check_pieces(p, docs, window):
    """Sequences have no gap, and the pieces are those of each row, as often as the row comes."""
    library = Tokenizer.from_file(PATH)
    assert sorted({r["sequence_id"] for r in p}) == list(range(len({r["sequence_id"] for r in p})))
    at = collections.defaultdict(list)
    for r in p:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= window
    want = collections.Counter()
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), window):
            own = ids[start : start + window]
            want[(i, start, tuple(own), len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(ids))] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["length"], r["ids_crc32"], r["doc_tokens"]) for r in p)


def test_draw_by_inversion():
    """The same law as the generator's, on sizes that both take; and sizes that only it takes."""
    draw = np.random.Generator(np.random.PCG64(3))
    got = np.array([by_inversion(draw, 30, 50, 20) for _ in range(20_000)])
    want = draw.hypergeometric(30, 50, 20, 20_000)
    assert abs(got.mean() - 7.5) < 0.05 and abs(got.var() / want.var() - 1) < 0.05
    assert abs(np.bincount(got, minlength=21) - np.bincount(want, minlength=21)).max() < 400
    large = [hypergeometric(draw, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(large) - 4e5) < 500 and 100 < np.std(large) < 1000
    assert hypergeometric(draw, 2 * 10**9, 5, 2 * 10**9) >= 2 * 10**9 - 5


@pytest.mark.parametrize("clash", ["_key", "_shard", "_position", "k", "row", "copy"])
def test_mixed_documents_clashing_columns(spark, clash):
    docs = spark.createDataFrame([(i, f"word {i}", "s", f"own {i}") for i in range(6)], f"doc_id long, text string, source string, {clash} string")
    got = mixed_documents(docs)
    assert got.columns == docs.columns and all(r[3] == f"own {r[0]}" for r in got.collect()) and got.count() == 6


def test_op9_brute_force(spark, tmp_path):
    """The registered query over equal rows, against a plain count of the words that the shards hold."""
    rng = np.random.default_rng(8)
    rows = [(int(i), " ".join(["w"] * int(n)), s) for i, n, s in zip(range(900), rng.integers(0, 40, 900), rng.choice(["a", "b", "c", "dd"], 900, p=[0.6, 0.2, 0.15, 0.05]), strict=True)]
    rows += [(5000, "x y z", "a")] * 7 + [(None, "x y", None), (None, None, None), (5001, "", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_mixing"](spark, str(tmp_path)).collect()
    size = lambda t: len(words(t))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(i), size(t)) for i, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, x in rows if x == s) for s in names]
    left, target, full = float(sum(sizes)), {}, set()
    while True:  # shares by weight 1, 2, 3, those beyond three times the size cut off and dealt to the others
        open_ = [i for i in range(len(names)) if i not in full]
        share = {i: left * (i % 3 + 1) / sum(j % 3 + 1 for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            target |= share
            break
        for i in over:
            target[i], left = 3.0 * sizes[i], left - 3 * sizes[i]
            full.add(i)
    of = {(repr(i), size(t)): s for i, t, s in rows}
    taken = collections.Counter()
    for r in got:
        s = names.index(of[(repr(r["doc_id"]), r["size"])])
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in range(len(names)):
        assert abs(taken[s] - target[s]) <= 40
    _, mix = mix_sources(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    own = {repr(i): size(t) for i, t, _ in rows if i is not None}
    held = collections.Counter()
    for r in mix.where("doc_id is not null").collect():
        held[repr(r["doc_id"])] += own[repr(r["doc_id"])]
    by_id = collections.Counter()
    for r in got:
        if r["doc_id"] is not None:
            by_id[repr(r["doc_id"])] += r["taken"]
    assert +held == +by_id


def test_packing_round_trip(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250").select("doc_id", "text")
    p = pack_documents(d, PATH, window=512, keep_ids=True).collect()
    check_pieces(p, [(r[0], r[1]) for r in d.collect()], 512)
    assert 1 - sum(r["length"] for r in p) / (512 * len({r["sequence_id"] for r in p})) < 0.02


def test_packing_odd(odd_docs, no_docs):
    check_pieces(pack_documents(odd_docs, PATH, keep_ids=True).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2048)
    assert pack_documents(no_docs, PATH).count() == 0


def best(ids, v, k, q):
    s = v @ v[q]
    return sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_topk_brute_force(spark, seed, monkeypatch):
    """Few values, so that ties are common; some shards small; huge values, which leave doubles."""
    from tidelake.llm import topk_search as module

    monkeypatch.setattr(module, "SHARD_VALUES", 150 * 8)
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (500, 8)) / 16 * (1e7 if seed == 2 else 1)
    rows = [(i, [float(x) for x in v[i]]) for i in range(500)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (None, rows[0][1]), (1150, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search(d, d.where("vec_id % 50 = 0")).collect()
    whole = np.floor(256 * v).astype(np.int64)
    for q in range(0, 500, 50):
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [x[1:] for x in mine] == best(np.arange(500), whole, 5, q)
    assert {r["query_id"] for r in got} == set(range(0, 500, 50))
    few = topk_search(d.where("vec_id < 3"), d.where("vec_id = 0"))
    assert few.count() == 2 and topk_search(d.limit(0), d).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(name, spark, duck):
    cols, got = rows_of(QUERIES[name](spark, SF))
    want_cols, want = rows_of_sql(duck, ORACLES[name])
    assert cols == want_cols and got == want and want


def test_urls(spark):
    urls = ["HTTP://User@WWW.Ex.com:80/a/?b=2&a=1&utm_x=3#f", "https://ex.com/a?a=1&b=2", "ex.com/a//?ref=x", None, ""]
    d = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in d.select(canonical_url(F.col("u"))).collect()] == ["ex.com/a?a=1&b=2", "ex.com/a?a=1&b=2", "ex.com/a", None, ""]


def test_revisits_odd(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, digest string, headers map<string,string>, r string"
    rows = [
        (1, "response", "http://a/x", 100, '"e"', "m", "d1", {"etag": '"e"', "content-type": "t", "date": "1"}, None),
        (2, "response", "http://a/x", 100, '"e2"', "m", "d2", {"etag": '"e2"'}, None),
        (3, "revisit", "http://a/x#f", 100, None, None, None, {}, None),  # same second: not earlier
        (4, "revisit", "http://a/x", 10**6, 'W/"e2"', None, None, {"date": "2", "content-type": "no", "x": None}, None),
        (5, "revisit", "http://a/x", 101, None, "other", None, None, None),
        (6, "revisit", "http://a/x", 102, None, None, "d2", None, None),
        (7, "revisit", None, 102, None, None, None, None, None),
        (8, "revisit", "http://a/x", None, None, None, "q", None, None),
        (9, "revisit", "http://b/", 102, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, schema)
    got = {r["record_id"]: r for r in resolve_revisits(d, slice_seconds=50).collect()}
    assert {k: (r["status"], r["resolved_id"]) for k, r in got.items()} == {3: ("no_response", None), 4: ("resolved", 2), 5: ("validator_mismatch", None), 6: ("resolved", 2), 7: ("no_response", None), 8: ("no_response", None), 9: ("no_response", None)}
    assert got[4]["headers"] == {"etag": '"e2"', "date": "2"} and got[4]["digest"] == "d2" and got[8]["digest"] == "q"
    twice = resolve_revisits(d.unionByName(d.where("record_id = 4")))
    assert twice.where("record_id = 4").count() == 2 and resolve_revisits(d.limit(0)).count() == 0


def test_water_fill():
    assert water_fill([100, 100], [1, 3], 200, 3) == [50, 150]
    t = water_fill([10, 100, 1000, 0], [1, 2, 3, 1], 1110, 3)
    assert t[0] == 30 and t[1] == 300 and abs(sum(t) - 1110) < 1e-9 and t[3] == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_split_tree(counts, shards, seed):
    quota = split_tree(np.array(counts), shards, seed)
    assert (quota >= 0).all() and quota.sum(axis=0).tolist() == counts
    each = quota.sum(axis=1)
    assert each.max() - each.min() <= max(1, int(np.ceil(np.log2(max(shards, 2)))) + 1)
    assert (quota == split_tree(np.array(counts), shards, seed)).all()


def test_mix(spark, odd_docs, no_docs):
    d = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/documents.parquet")
    plan, mix = mix_sources(d)
    p, m = plan.toPandas().merge(d.select("doc_id", "source").toPandas(), on="doc_id"), mix.toPandas()
    sizes = p.groupby("source")["size"].sum()
    targets = dict(zip(sorted(sizes.index), water_fill([int(sizes[s]) for s in sorted(sizes.index)], [1 + i % 3 for i in range(len(sizes))], int(sizes.sum()), 3), strict=True))
    taken = p.groupby("source").taken.sum()
    assert all(abs(taken[s] - targets[s]) < 0.01 * targets[s] for s in targets)
    assert (p.taken <= 3 * p["size"]).all()
    times = m.groupby("doc_id").size()
    assert all(times.get(r.doc_id, 0) == r.passes for r in p.itertuples())
    assert m.groupby(["doc_id", "copy"]).size().max() == 1
    again = mix_sources(d)[1].toPandas().sort_values(["doc_id", "copy"])
    assert again.shard.tolist() == m.sort_values(["doc_id", "copy"]).shard.tolist()
    by = m.groupby("shard").size()
    assert len(by) == 16 and by.max() < 2 * by.min()


def test_mix_odd(odd_docs, no_docs):
    plan, mix = mix_sources(odd_docs)
    rows = plan.collect()
    assert len(rows) == 12 and sum(r["passes"] for r in rows) == mix.count()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in rows) == sorted((repr(r["doc_id"]), len(words(r["text"]))) for r in odd_docs.collect())
    assert mixed_documents(odd_docs).columns == odd_docs.columns and mixed_documents(no_docs).count() == 0
    assert mix_sources(no_docs)[0].count() == 0


def without_passages(texts, size):
    """Texts less every byte in a string of `size` bytes that starts twice or more; None where only white space is left."""
    raw = [(t or "").encode() for t in texts]
    at = collections.Counter(t[p : p + size] for t in raw for p in range(len(t) - size + 1))
    out = []
    for text, t in zip(texts, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if at[t[p : p + size]] > 1:
                gone[p : p + size] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        out.append((text is None or not gone.any() or bool(words(left)), left if text is not None else None))
    return out


def test_pipeline_stages_brute_force(spark):
    """Near-duplicates and repeated passages against plain Python, each on the input that the pipeline gives it."""
    pipeline = importlib.import_module("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    sf = SF.replace("sf0.01", "sf0.001")
    docs = stages["toxicity"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    one = stages["near_duplicates"](spark, docs, sf)
    left = sorted((r["doc_id"], r["text"]) for r in one.collect())
    texts = dict(rows)
    assert [i for i, _ in left] == sorted({least for i, n, least in linked(rows, 5, 80, 100) if n} | {i for i, t in rows if not words(t)})
    assert all(t == texts[i] for i, t in left)
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["repeated_passages"](spark, one, sf).collect()}
    want = {i: (t, None if t is None else len(t)) for (i, _), (stays, t) in zip(left, without_passages([t for _, t in left], 240), strict=True) if stays}
    assert cut == want


def test_pipeline(spark):
    """Each stage of the pipeline on the smallest table, and its own rule on its own input."""
    pipeline = importlib.import_module("corpus_pipeline")
    sf = SF.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from tidelake.llm.common import materialize

    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.4 * len(ids)
        if name != "mixing":
            assert out.count() == len(now)
        docs, ids = out, now
    p = pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert p.length.sum() == p[p.start == 0].doc_tokens.sum()
    assert pipeline.STAGES[0][1](spark, docs.limit(0), sf).count() == 0


def test_topk_repeated_rows(spark):
    """Two equal query rows have k rows each, and a query leaves out its own row alone."""
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = d.where("vec_id = 0").unionByName(d.where("vec_id = 0"))
    got = sorted((r["rank"], r["vec_id"]) for r in topk_search(d, twice, k=3).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3)]
    # the copy of the query's row is another row
    both = d.unionByName(d.where("vec_id = 0"))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk_search(both, d.where("vec_id = 0"), k=3).collect())
    assert got == [(1, 0, 65536), (2, 1, 58880), (3, 2, 32768)]
    # a row of the same id with other components is no copy of the query either
    other = d.unionByName(spark.createDataFrame([(0, [0.8, 0.0])], d.schema))
    assert sorted((r["rank"], r["vec_id"]) for r in topk_search(other, d.where("vec_id = 0"), k=3).collect()) == [(1, 1), (2, 0), (3, 2)]


def test_mix_rows_that_differ_in_source_alone(spark, tmp_path):
    rows = [(1, "x y", "a"), (1, "x y", "b"), (2, "z " * 7, "a"), (3, "q " * 12, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_mixing"](spark, str(tmp_path)).collect()
    mixed = mixed_documents(d).collect()
    assert len(got) == 4
    held = collections.Counter((r["doc_id"], r["source"]) for r in mixed)
    plan, mix = mix_sources(d)
    assert len(mixed) == mix.count()
    for i, text, source in rows:
        size = len(text.split())
        mine = [r for r in got if r["doc_id"] == i and r["source_size"] == (9 if source == "a" else 14)]
        assert [r["taken"] for r in mine] == [held[(i, source)] * size]


def test_shard_runs_equal_the_tree(spark, monkeypatch):
    """The driver's part of the tree stays small, and the subtrees of tasks go on with it."""
    from tidelake.llm import mixing

    counts = np.array([300, 0, 41, 7], np.int64)
    whole = split_tree(counts, 37, 5)
    for most in (1 << 16, 16, 1):
        monkeypatch.setattr(mixing, "TOP_ENTRIES", most)
        got = np.zeros_like(whole)
        at = collections.defaultdict(list)
        for r in mixing.shard_runs(spark, counts, 37, 5).collect():
            got[r["shard"], r["sid"]] = r["n"]
            at[r["sid"]].append((r["first"], r["n"]))
        assert (got == whole).all()
        for i, runs in at.items():
            runs.sort()
            assert [f for f, _ in runs] == [0, *np.cumsum([n for _, n in runs])[:-1]] and sum(n for _, n in runs) == counts[i]
