"""Scores and rules: exact figures by brute force, models by held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from ..conftest import SF
from pyspark.sql import functions as F

from tidelake.llm import lm_score
from tidelake.llm.lm_score import BUCKETS, GRID, deleted_interpolation_scores, em_weights
from tidelake.llm.perplexity_rules import BANDS, _discounts, kneser_ney, quality_rules
from tidelake.llm.site_quality import site_quality
from tidelake.llm.toxicity import STEMS, distinct_features, ftrl_pass, toxicity_scores, weights_of

from .conftest import lower, words


def auc(score, label):
    r = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (r[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/documents.parquet").where("doc_id % 2 = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/labels.parquet")


def test_toxicity_held_out(docs, labels):
    got = toxicity_scores(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where("held_out and y is not null").select("score", "predicted", "y").toPandas()
    assert auc(got.score.to_numpy(), got.y.to_numpy()) > 0.9
    assert ((got.predicted == 1) & (got.y == 0)).sum() < 0.05 * len(got)


def test_toxicity_blind_to_held_out(odd_docs, no_docs, spark):
    """Labels of held-out rows change nothing; odd rows get a score; equal rows equal ones."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:5]
    base = [(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)]
    schema = "doc_id long, toxic int"
    a = toxicity_scores(odd_docs, spark.createDataFrame(base, schema))
    b = toxicity_scores(odd_docs, spark.createDataFrame(base + [(i, 1) for i in ids], schema))
    assert a.columns == [*odd_docs.columns, "held_out", "score", "predicted"]
    x, y = (sorted((repr(r["doc_id"]), repr(r["text"]), r["held_out"], r["score"]) for r in d.collect()) for d in (a, b))
    assert x == y and all(0 <= r[3] <= 1 for r in x) and len(x) == 12
    assert toxicity_scores(no_docs, spark.createDataFrame(base, schema)).count() == 0
    assert {r["score"] for r in toxicity_scores(odd_docs, spark.createDataFrame([], schema)).collect()} == {0.5}


def test_ftrl_is_sparse():
    """Marks get weight; L1 leaves a good part of the noise at zero."""
    rng = np.random.default_rng(0)
    rows = [rng.choice(1000, 30, replace=False).astype(np.int32) for _ in range(600)]
    y = np.array([int(7 in r or 8 in r) for r in rows])
    z, n = np.zeros(1001), np.zeros(1001)
    for _ in range(5):
        ftrl_pass(rows, y, z, n, 0.2, 1.0, 3.0, 0.1)
    w = weights_of(z, n, 0.2, 1.0, 3.0, 0.1)
    assert w[7] > 0.5 and w[8] > 0.5 and np.count_nonzero(w[:-1]) < 600


def test_site_quality(docs, labels):
    got = site_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.9
    assert ((~got.kept) & (got.quality == 1)).sum() < 0.02 * len(got)


def test_site_rates_shrink(spark):
    """A site with few labels stays near its parent, one with many goes its own way; unknown ones take the parent's."""
    docs = [(i, "same words here", "big" if i < 400 else "small" if i < 402 else "new", "p") for i in range(410)]
    labels = [(i, 0 if i < 400 else 1) for i in range(402)]
    d = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    got = {r["host"]: r for r in site_quality(d, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path"), folds=1, held=5).join(d.select("doc_id", "host"), "doc_id").collect()}
    assert got["big"]["path_rate"] < got["new"]["path_rate"] < got["small"]["path_rate"] < 1


def test_site_quality_odd(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert site_quality(odd_docs, labels, F.col("source"), F.col("lang")).count() == 12
    assert site_quality(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    assert site_quality(odd_docs, labels.limit(0), F.col("source"), F.col("lang")).where("score is null").count() == 0


def rules(text):
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_rules_brute_force(spark, odd_docs, no_docs):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("k")).unionByName(odd_docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules(d).collect()
    want = [(r["doc_id"], *rules(r["text"])) for r in d.collect()]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    fit = [r for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in fit) > 0.98 * len(fit)
    assert quality_rules(no_docs).count() == 0


def plain_kneser_ney(streams, order=4):
    """log2 probability of each byte string of a language's texts, by dictionaries."""
    top = collections.Counter(t[max(0, i - order + 1) : i + 1].rjust(order, b"\0") for t in streams for i in range(len(t)))
    tables = [top]
    for _ in range(order - 1):
        tables.append(collections.Counter(g[1:] for g in tables[-1]))
    p = {}
    for t in reversed(tables):
        have = collections.Counter(t.values())
        n1, n2, n3, n4 = (have[k] for k in (1, 2, 3, 4))
        d = (0.5, 0.75, 0.9)
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = tuple(min(max(k - (k + 1) * y * b / max(a, 1), 0.1), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        total, mass = collections.Counter(), collections.Counter()
        for g, n in t.items():
            total[g[:-1]] += n
            mass[g[:-1]] += d[min(n, 3) - 1]
        p = {g: (n - d[min(n, 3) - 1] + mass[g[:-1]] * (p[g[1:]] if len(g) > 1 else 1 / 256)) / total[g[:-1]] for g, n in t.items()}
    return {g: math.log2(x) for g, x in p.items()}


def test_kept_brute_force(spark, odd_docs):
    """Perplexities by a plain model; bands and verdicts by plain quartiles."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("k")).unionByName(odd_docs)
    got = collections.defaultdict(list)
    for r in quality_rules(d).collect():
        got[repr(r["doc_id"])].append(r)
    by = collections.defaultdict(list)
    for r in d.collect():
        w = words(r["text"])
        by[r["lang"]].append((r["doc_id"], r["text"], len(w), (" " + " ".join(w) + " ").encode() if w else b""))
    checked = 0
    for docs_ in by.values():
        logs = plain_kneser_ney([s for *_, s in docs_])
        rows = [(i, t, n, len(s), -sum(logs[s[max(0, j - 3) : j + 1].rjust(4, b"\0")] for j in range(len(s)))) for i, t, n, s in docs_]
        bands = []
        for measure, (least, rate) in ((3, BANDS["bits_per_byte"]), (2, BANDS["bits_per_word"])):
            x = sorted(r[4] / r[measure] for r in rows if r[2] >= 50)
            q = [x[math.ceil(f * len(x)) - 1] for f in (0.25, 0.5, 0.75)] if x else None
            bands.append((measure, q and q[1], q and rate * max((q[2] - q[0]) / 1.349, least)))
        for i, t, n, size, bits in rows:
            own = [r for r in got[repr(i)] if r["n_words"] == n]
            edges = [(bits / (size, n)[m == 2], mid, room * math.sqrt(1 + 400 / max(size, 1))) for m, mid, room in bands if n and mid]
            for r in own:
                if size > 300:  # one shared hash weighs more in shorter or repetitive ones
                    assert abs(r["bits_per_byte"] - bits / size) < 0.03 * bits / size
                if all(abs(abs(x - mid) - room) > 0.05 * room for x, mid, room in edges):  # not at the very edge
                    assert r["kept"] == (not rules(t)[5] and all(abs(x - mid) <= room for x, mid, room in edges))
                    checked += 1
    assert checked > 350


def test_site_quality_brute_force(spark):
    """Posteriors over every row of a small table, against sums by hand."""
    rng = np.random.default_rng(6)
    docs_ = [(i, " ".join(rng.choice(["good", "bad", "so", "la", "ti"], 6, p=[0.3, 0.1, 0.2, 0.2, 0.2] if i % 3 else [0.1, 0.4, 0.2, 0.2, 0.1])), f"h{i % 4 if i % 7 else 'rare' + str(i)}", f"p{i % 5}") for i in range(300)] + [(900, None, None, None), (901, "", "h1", None)]
    labels_ = [(i, int(i % 3 > 0)) for i in range(0, 300, 2)]
    d = spark.createDataFrame(docs_, "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in site_quality(d, spark.createDataFrame(labels_, "doc_id long, quality int"), F.col("host"), F.col("path"), folds=1, held=5).collect()}
    y = dict(labels_)
    at = {i: (h, p) for i, _, h, p in docs_}
    rate = (sum(y.values()) + 1) / (len(y) + 2)

    def sites(key):
        n, good = collections.Counter(), collections.Counter()
        for i, v in y.items():
            n[key(i)] += 1
            good[key(i)] += v
        return n, good

    def strength(n, good, mean):
        ss = sum(n[s] * (good[s] / n[s] - mean(s)) ** 2 for s in n)
        chance = sum(mean(s) * (1 - mean(s)) for s in n)
        most = sum(n[s] * mean(s) * (1 - mean(s)) for s in n)
        total = sum(n.values())
        between = max((ss - chance) / max(total - len(n), 1), 1e-9)
        return min(max(most / total / between - 1, 2.0), 1000.0)

    hn, hg = sites(lambda i: at[i][0])
    a = strength(hn, hg, lambda _: rate)
    host = lambda h: (hg[h] + a * rate) / (hn[h] + a)
    pn, pg = sites(lambda i: at[i])
    b = strength(pn, pg, lambda s: host(s[0]))
    for i, (h, p) in at.items():
        want_host = host(h) if hn[h] else rate
        want_path = (pg[h, p] + b * want_host) / (pn[h, p] + b) if pn[h, p] else want_host
        r = got[i]
        assert abs(r["host_rate"] - want_host) < 1e-9 and abs(r["path_rate"] - min(max(want_path, 0.001), 0.999)) < 1e-9
        odds = math.log(r["path_rate"] / (1 - r["path_rate"])) + r["evidence"]
        assert abs(r["score"] - 1 / (1 + math.exp(-odds))) < 1e-9 and r["kept"] == (r["score"] >= 0.5)
    assert got[900]["evidence"] == got[901]["evidence"] == 0


def test_ftrl_pass_against_plain():
    """One pass of the vectorised update, coordinate by coordinate in plain Python."""
    rng = np.random.default_rng(4)
    rows = [rng.choice(40, 7, replace=False).astype(np.int32) for _ in range(80)]
    y = rng.integers(0, 2, 80)
    z, n = np.zeros(41), np.zeros(41)
    ftrl_pass(rows, y, z, n, 0.2, 1.0, 0.5, 0.1)
    pz, pn = [0.0] * 41, [0.0] * 41
    for x, label in zip(rows, y, strict=True):
        own, w = [*x.tolist(), 40], {}
        for i in own:
            l1 = 0.0 if i == 40 else 0.5
            w[i] = 0.0 if abs(pz[i]) <= l1 else -(pz[i] - math.copysign(l1, pz[i])) / ((1.0 + math.sqrt(pn[i])) / 0.2 + 0.1)
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in own:
            sigma = (math.sqrt(pn[i] + g * g) - math.sqrt(pn[i])) / 0.2
            pz[i] += g - sigma * w[i]
            pn[i] += g * g
    assert np.allclose(z, pz) and np.allclose(n, pn)


def test_toxicity_features_against_plain():
    """Which texts share how many distinct features follows from their words, stems and pairs."""
    import pyarrow as pa

    texts = ["Bad words, here and there", "bad WORDS here", "", "wordsmith wordsworth", "x", "here and there bad words"]

    def plain(t):
        w = re.findall(r"[a-z0-9\x80-\uffff]+", lower(t))
        out = {("w", x) for x in w} | {(k, x[:k]) for x in w for k in STEMS if len(x) > k}
        return out | {("pair", gap, a, b) for gap in (1, 2, 3) for a, b in zip(w, w[gap:], strict=False)}

    got = [set(x.tolist()) for x in distinct_features(pa.array(texts), 30)]
    want = [plain(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_kneser_ney_sums_to_one(spark):
    """With all bytes that follow a context, and what backs off, probabilities are proper; counts decide the order."""
    rng = np.random.default_rng(1)
    data = b" " + bytes(rng.choice(list(b"abcd "), 4000))
    codes = collections.Counter()
    for i in range(len(data)):
        part = data[max(0, i - 3) : i + 1]
        codes[int.from_bytes(part, "big")] += 1
    p = {r["code"]: r["p"] for r in kneser_ney(spark.createDataFrame([("en", c, n) for c, n in codes.items()], "lang string, code long, n long")).collect()}
    assert set(p) == set(codes) and all(0 < x < 1 for x in p.values())
    by = collections.defaultdict(float)
    for c, x in p.items():
        by[c >> 8] += x
    assert all(s < 1.0001 for s in by.values())
    assert sum(s > 0.95 for s in by.values()) > 0.5 * len(by)
    assert all(0 < d < k for k, d in enumerate(_discounts(50, 20, 10, 5), 1))


def test_lm_base_brute_force(spark, odd_docs, no_docs):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 500").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = [(r[0], [*words(lower(r[1])), None]) for r in d.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in rows)
    got = deleted_interpolation_scores(d).collect()
    assert sorted((repr(r[0]), r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    kept = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)
    assert deleted_interpolation_scores(no_docs).count() == 0


def interpolated(rows, order, held=2, folds=7):
    """The whole model in plain Python: (score of a text, probability of a token after a context)."""
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % folds
    padded = [(fold(i), [START] * (order - 1) + words(lower(t)) + [END]) for i, t in rows]
    grams = lambda ws, k: [tuple(ws[j - k : j + 1]) for j in range(order - 1, len(ws))]
    count = [collections.Counter(g for f, ws in padded if f != held for g in grams(ws, k)) for k in range(order)]
    tune = [collections.Counter(g for f, ws in padded if f == held + 1 for g in grams(ws, k)) for k in range(order)]

    def parts(gram, c, types):
        tokens = sum(c[0].values())
        out = [1 / (types + 1)]
        out.append(c[0][gram[-1:]] / tokens if tokens else out[0])
        bucket = 0
        for k in range(1, order):
            context = gram[-k - 1 : -1]
            h = c[0][(END,)] if context == (START,) * k else c[k - 1][context]
            out.append(c[k][gram[-k - 1 :]] / h if h else out[-1])
            bucket = bucket * len(BUCKETS) + min(int(np.searchsorted(BUCKETS, h)), len(BUCKETS) - 1)
        return out, bucket

    types = len(count[0])
    left = [a - b for a, b in zip(count, tune, strict=True)]
    left = [collections.Counter(a) for a in left]
    by = collections.defaultdict(list)
    for f, ws in padded:
        if f == held + 1:
            for g in grams(ws, order - 1):
                p, bucket = parts(g, left, types)
                by[bucket].append([p[0], *(2.0 ** (round(math.log2(x) * GRID) / GRID) if x else 0.0 for x in p[1:])])

    def em(ps, prior):
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(60):
            new = list(prior)
            for p in ps:
                total = sum(a * b for a, b in zip(w, p, strict=True))
                for k in range(order + 1):
                    new[k] += w[k] * p[k] / total
            w = [x / sum(new) for x in new]
        return w

    pooled = em([p for ps in by.values() for p in ps], [0.1] * (order + 1))
    weights = {b: em(ps, [10 * x for x in pooled]) for b, ps in by.items()}

    def prob(gram):
        p, bucket = parts(gram, count, types)
        return sum(a * b for a, b in zip(weights.get(bucket, pooled), p, strict=True))

    return [(i, sum(math.log10(prob(g)) for g in grams(ws, order - 1))) for (i, _), (_, ws) in zip(rows, padded, strict=True)], prob, [w[0] for w in count[0]]


START, END = "<s>", "</s>"


@pytest.mark.parametrize("order", [2, 3])
def test_lm_brute_force(spark, monkeypatch, order):
    """Scores equal those of the plain model, over many blocks, parts and merges; and that model is a distribution."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm_score, "PART_BYTES", 3000)
    monkeypatch.setattr(lm_score, "FAN", 2)
    rng = np.random.default_rng(2)
    vocab = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(vocab[(rng.zipf(1.4, rng.integers(0, 30)) * (i % 3 + 1)) % 60])) for i in range(400)] + [(7, "W1 w1"), (7, "W1 w1"), (None, "w1 w2"), (401, None)]
    want, prob, known = interpolated(rows, order)
    got = deleted_interpolation_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect()
    assert sorted((repr(r[0]), round(r["score"], 6)) for r in got) == sorted((repr(i), round(x, 6)) for i, x in want)
    for context in [(START,) * (order - 1), (*((START,) * (order - 2)), "w1"), ("w2", "w1")[-order + 1 :], ("never", "seen")[-order + 1 :]]:
        assert abs(sum(prob((*context, w)) for w in [*known, "unknown"]) - 1) < 1e-9


def test_em_recovers_weights():
    rng = np.random.default_rng(5)
    token = np.where(rng.random(20_000) < 0.3, rng.integers(0, 2, 20_000), rng.integers(0, 100, 20_000))  # two frequent ones
    steps, n = np.unique(np.where(token < 2, round(math.log2(0.5) * GRID), 1), return_counts=True)
    w = em_weights(np.vstack([np.zeros(len(n), int), steps]), n, 99)
    assert all(abs(x.sum() - 1) < 1e-9 for x in w.values())
    assert abs(w[0][1] - 0.3) < 0.05
    assert em_weights(np.zeros((3, 0), int), np.zeros(0), 9)[-1].tolist() == [1 / 3] * 3


def test_a_block_is_scored_in_bounded_memory():
    """Beside the text some bytes for each token: columns of probabilities of all of a block's tokens would add half as many."""
    import tracemalloc

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(20_000)]
    texts = pa.array([" ".join(rng.choices(vocabulary, k=2000)).encode() for _ in range(150)])
    block = pa.table({"block": [7], "kind": pa.array([lm_score.TRAIN], pa.int32()), "ids": [list(range(150))], "texts": pa.array([texts.to_pylist()], pa.list_(pa.binary()))})
    asked = pa.Table.from_batches(list(lm_score._requests(2, 3)(block.select(["block", "kind", "texts"]).to_batches())))
    answers = pa.concat_tables([lm_score._answers(None, asked.slice(i, 1)) for i in range(asked.num_rows)])
    kinds = [("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    score = lm_score._score(2, 300_150, 20_001, {-1: np.array([0.2, 0.3, 0.5])}, pa.schema(kinds))
    tracemalloc.start()
    try:
        got = score(None, block, answers)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    tokens = sum(got["n_tokens"].to_pylist())
    assert tokens == 300_150
    assert most < 100 * tokens
