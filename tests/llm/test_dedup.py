"""Suffix-array dedup and the Jaccard join against brute force."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ..conftest import SF

from tidelake.llm import jaccard_join, suffix_dedup
from tidelake.llm.jaccard_join import Bands, jaccard_components, one_of_each_group
from tidelake.llm.suffix_dedup import RunLengthIndex, without_repeats

from .conftest import lower, words


def repeats(texts, size):
    at = defaultdict(int)
    for t in texts:
        for p in range(len(t) - size + 1):
            at[t[p : p + size]] += 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if at[t[p : p + size]] > 1:
                mask[p : p + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out.append((len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_index_statistics():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abc") for _ in range(300))
    texts = [base, base[:120] + b"x" + base[100:], bytes(rng.choice(b"ab") for _ in range(200)), b"aaaaaaaaaaaaaaaaaaaa"]
    index = RunLengthIndex(texts, 40)
    assert index.run_lengths.sum() == index.n
    stats = index.matching_statistics()
    whole = bytes(index.buf)
    for start, text in zip(index.starts, texts, strict=True):
        for p in range(start, start + len(text)):
            n = 0
            while whole.find(whole[p : p + n + 1]) not in (-1, p) or whole.find(whole[p : p + n + 1], p + 1) != -1:
                n += 1
                if n >= len(text) + 1 or p + n >= len(whole):
                    break
            room = start + len(text) - p
            assert min(stats[p], room) == min(n, room)


@pytest.mark.parametrize("most", [2000, 2])
def test_suffix_dedup_brute_force(spark, monkeypatch, most):
    """Also with an index limit so small that shared anchors are settled by window counts."""
    monkeypatch.setattr(suffix_dedup, "INDEX_SEGMENTS", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 260").select("doc_id", "text").collect()
    rows = [(r[0], r[1]) for r in docs] + [(9001, docs[3][1] + "x" + docs[3][1]), (9002, "ab" * 700), (9003, None), (9004, "é" * 500)]
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([r[0] for r in rows], repeats([(r[1] or "").encode() for r in rows], 400), strict=True))
    assert got == want


def test_suffix_dedup_equal_rows(spark, monkeypatch):
    """Many rows that are equal in id and text cost no more than others, on either path."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(None, base)] * 3000 + [(1, base[:420] + "x" * 50), (2, "y" * 399), (2, "y" * 399)]
    for most in (2000, 1):
        monkeypatch.setattr(suffix_dedup, "INDEX_SEGMENTS", most)
        got = sorted((tuple(r[:5]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        few = [(i, t.encode()) for i, t in rows[2998:]]
        want = [(i, *r) for (i, _), r in zip(few, repeats([t for _, t in few], 400), strict=True)]
        assert got == sorted(want[:1] * 2998 + want, key=repr)


def stages_of(spark, group, action):
    """What the action gives, and the figures of the stages that it ran."""
    context = spark.sparkContext
    try:
        context.setJobGroup(group, group)
        got = action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    ran = {k for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds}
    return got, [x for x in (store.lastStageAttempt(k) for k in sorted(ran)) if x.status().toString() == "COMPLETE"]


def test_suffix_dedup_shuffles_texts_once(spark):
    """The bytes that shuffles write stay under 1.9 times texts that don't compress; each shuffle of the texts adds 1."""
    rng = random.Random(6)
    texts = [rng.randbytes(2000).decode("latin-1").translate({i: 33 + i % 94 for i in range(256)}) for _ in range(1500)]
    texts[1] = texts[0][:700] + texts[1][700:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, stages = stages_of(spark, "texts-once", lambda: suffix_dedup.suffix_dedup(docs).select("doc_id", "n_removed", "kept_sha256").collect())
    assert sorted((r[0], r[1]) for r in got if r[1]) == [(0, 700), (1, 700)]
    assert 0 < sum(x.shuffleWriteBytes() for x in stages) < 1.9 * sum(map(len, texts))


def test_suffix_dedup_odd(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = sorted(repeats([(t or "").encode() for _, t in rows], 400))
    assert sorted(tuple(r[1:5]) for r in suffix_dedup.suffix_dedup(odd_docs).collect()) == want
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
    left = without_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    assert {r["doc_id"] for r in left.collect()} == {3, 4, 5, 7, None, 9}  # 7 keeps its own end
    assert without_repeats(no_docs).count() == 0


def linked(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    pairs = {(a, b) for l in by.values() for i, a in enumerate(l) for b in l[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


def made_up(seed):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(50)]
    rows = []
    for g in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 25, 60]))]
        for _ in range(8):
            b = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(b))
                b[p : p + 1] = rng.choice([[rng.choice(vocab)], [], [b[p], rng.choice(vocab)]])
            rows.append((len(rows) + 1000 * g, " ".join(b)))
    return rows


@pytest.mark.parametrize(("n", "num", "den", "crowd"), [(4, 85, 100, 2048), (5, 80, 100, 3)])
def test_jaccard_brute_force(spark, monkeypatch, n, num, den, crowd):
    """Also with buckets so small that they are dealt out again, and cut into pairs of blocks."""
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    docs = [(r[0] + 100_000, r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").select("doc_id", "text").collect()]
    rows = docs + made_up(n)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=n, num=num, den=den)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(linked(rows, n, num, den))


def test_jaccard_odd(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [(r[0], r[1], r[2]) for r in jaccard_components(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(linked(rows, 4, 85, 100), key=repr)
    assert jaccard_components(no_docs).count() == 0
    one = one_of_each_group(odd_docs)
    assert one.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 8, 9, None, None], key=repr)


def test_meetings_stream():
    """However the sorted rows are cut into batches, the same rows come out."""
    rng = random.Random(5)
    rows = sorted((rng.randrange(12), rng.randrange(9)) for _ in range(90)) + [(99, 4)] * 7
    by = defaultdict(set)
    for b, c in rows:
        by[b].add(c)
    want = sorted((b, c, min(s)) for b, s in by.items() if len(s) > 1 for c in s)
    for size in (1, 2, 7, 1000):
        batches = [pa.record_batch({"b": [r[0] for r in rows[i : i + size]], "c": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        assert sorted(tuple(r.values()) for x in jaccard_join._meetings(iter(batches)) for r in x.to_pylist()) == want


def test_unlinked_crowd(spark, monkeypatch):
    """Many sets that meet everywhere and hardly link: block pairs and several rounds of nearest neighbours."""
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = list(base)
        for p in rng.sample(range(40), rng.choice([1, 2, 3])):
            own[p] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(own)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=1, num=90, den=100)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(linked(rows, 1, 90, 100))


@pytest.mark.parametrize("clash", ["_key", "k", "row", "stay", "b", "component"])
def test_clashing_columns(spark, clash):
    docs = spark.createDataFrame([(1, "one two three four five six", "own"), (2, "one two three four five six", "other"), (3, "else", None)], f"doc_id long, text string, {clash} string")
    assert sorted(tuple(r) for r in one_of_each_group(docs).collect()) == [(1, "one two three four five six", "own"), (3, "else", None)]


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_bands_cover(num, den):
    """Every linked pair of sizes shares a band, whose segments cover its difference."""
    bands = Bands(num, den, 3000, {k: 10**k for k in range(12)})
    for s in [*range(1, 80), 333, 1024]:
        k = bands.band(s)
        exact, one = bands.plan[k]
        for t in range(s, s * den // num + 1):
            assert bands.band(t) in (k, k + 1)
            assert t <= bands.partners(k)
            both = -(-num * (s + t) // (den + num))
            assert exact + 2 * one > s + t - 2 * min(both, s)


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    """Random links, a path, a star, a loop and repeats, against union-find; and no links at all."""
    from tidelake.llm.components import connected_components

    rng = random.Random(seed)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] * 2 + [(i, i + 1) for i in range(1000, 1030)] + [(5000, i) for i in range(4000, 4040)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = connected_components(spark.createDataFrame(links, "u long, v long"))
    assert {r[0]: r[1] for r in got.collect()} == {x: root(x) for x in list(parent) if root(x) != x}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_components_by_rounds_and_in_a_task(spark, monkeypatch, few):
    """By rounds alone, by rounds and then a task, and in a task alone: the smallest node of each component."""
    from tidelake.llm import components

    monkeypatch.setattr(components, "FEW", few)
    order = list(range(200))
    random.Random(3).shuffle(order)
    path = [(order[i], order[i + 1]) for i in range(120)]
    links = path + path[:9] + [(9000, 1000 + i) for i in range(50)] + [(-5, 2**62), (2**62, -(2**62)), (4, 4), (None, 3), (3, None)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"))
    least = min(order[:121])
    want = {n: least for n in order[:121] if n != least} | {n: 1000 for n in [9000, *range(1001, 1050)]} | {-5: -(2**62), 2**62: -(2**62)}
    rows = got.collect()
    assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want


def test_components_of_few_links_take_few_tasks(spark):
    """Rounds of joins over few links cost the driver a task for each shuffle partition again and again."""
    from tidelake.llm.components import connected_components

    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    context, group = spark.sparkContext, "components-of-few-links"
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        got = connected_components(spark.range(40).selectExpr("id as u", "id + 1 as v"))
        assert {(r[0], r[1]) for r in got.collect()} == {(i, 0) for i in range(1, 41)}
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        assert stages and sum(s.numTasks for s in stages if s) < 50
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_of_each_group_keeps_a_stated_row(spark):
    """Of rows equal in id and text the one with the smallest other columns, however the rows are dealt out."""
    from tidelake.llm.jaccard_join import one_of_each_group

    rows = [(1, "a b c d e f g", s, n) for s, n in (("y", 1), ("x", 9), ("x", 2), (None, 5))] + [(2, "a b c d e f g", "a", 0), (3, "", "q", 1), (3, "", "b", 1)]
    for parts in (1, 4):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(parts)
        got = sorted(tuple(r) for r in one_of_each_group(d, words=5, num=80, den=100).collect())
        assert got == [(1, "a b c d e f g", "x", 2), (3, "", "b", 1)]


def test_jaccard_in_turns(spark, monkeypatch):
    """Buckets that a shuffle can't hold at once, in the index, in crowded buckets and with sketches, go in shares."""
    for name, value in (("LEAST_ROWS", 1), ("LEAST_BYTES", 1), ("ROWS_A_TOKEN", 0.3), ("BYTES_A_TOKEN", 120), ("CROWD", 6), ("NEAREST", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    parts = defaultdict(list)
    written = jaccard_join.materialize_in_turn

    def counted(frames, tag):
        frames = list(frames)
        parts[tag].append(len(frames))
        return written(frames, tag)

    monkeypatch.setattr(jaccard_join, "materialize_in_turn", counted)
    rows = made_up(5)[:120]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=2, num=80, den=100)
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == sorted(linked(rows, 2, 80, 100))
    assert parts["buckets"][0] > 1 and max(parts["pairs"]) > 1


def test_tables_leave_no_shuffle_files(spark):
    """Else a chain of tables takes the disk of all its shuffles until the driver collects its garbage."""
    from tidelake.llm.common import REMOVE_SHUFFLES, materialize

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {x for x in names if x.startswith("shuffle_")}

    own, before = spark.conf.get(REMOVE_SHUFFLES, None), shuffles()
    rows = spark.range(1000).withColumn("g", F.col("id") % 7)
    assert materialize(rows.repartition(5, "g").groupBy("id").agg(F.max("g")), "left").count() == 1000
    deadline = time.time() + 20
    while (left := {x for x in shuffles() if x.endswith(".data")} - before) and time.time() < deadline:
        time.sleep(0.2)
    # the count's own row for each task may be there
    assert sum(1 for _ in left) <= 1
    assert spark.conf.get(REMOVE_SHUFFLES, None) == own
