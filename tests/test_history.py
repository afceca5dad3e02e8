"""History of hot keys in slices, versions as of a time, and batches that add to a history, against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidelake.operators import history as h
from tidelake.streaming.history import HistoryTable

CHANGES = "part int, pos long, op string, k long, x long, y string, ts_ms long"
KEYS, DATA = ["k"], ["x", "y"]


def make(n, seed, keys=6):
    """Changes of some keys; key 0 has half of them, times repeat, values too, and some are null."""
    r = random.Random(seed)
    out = []
    for pos in range(n):
        k = 0 if r.random() < 0.5 else r.randrange(1, keys)
        out.append((r.randrange(2), pos, r.choice("cuuud"), k, r.choice([None, 1, 2]), r.choice([None, "a"]), r.randrange(n // 2)))
    return out


def plain(rows):
    """Versions (k, x, y, from, to, current, deleted) of a change log."""
    out = []
    for k in {r[3] for r in rows}:
        kept, before = [], None
        for part, pos, op, _, x, y, t in sorted((r for r in rows if r[3] == k), key=lambda r: (r[6], r[0], r[1])):
            now = ("d",) if op == "d" else ("v", x, y)
            if now != before:
                kept.append((t, now))
            before = now
        for (t, now), following in zip(kept, [*kept[1:], None], strict=True):
            if now[0] == "v":
                out.append((k, now[1], now[2], t, following and following[0], following is None, following is not None and following[1][0] == "d"))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("k", "x", "y", "valid_from", "valid_to", "is_current", "is_deleted").collect()), key=repr)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(h, "PLAIN_BYTES", -1)
    monkeypatch.setattr(h, "HOT_ROWS", 40)


@pytest.mark.parametrize("bounds", [0, 1_000_000])
def test_hot_key_in_slices(spark, small, monkeypatch, bounds):
    """Slices give what one task gives, whether bounds are broadcast or joined, and a slice has few of the key's rows."""
    monkeypatch.setattr(h, "BROADCAST_BOUNDS", bounds)
    data = make(1200, 1)
    log = spark.createDataFrame(data, CHANGES)
    assert rows(h.record(log, KEYS, DATA)) == plain(data)
    sizes = h.sliced(h.staged(log, KEYS, DATA), KEYS, "valid_from").groupBy("k", h.SLICE).count().collect()
    hot = [r["count"] for r in sizes if r["k"] == 0]
    assert len(hot) > 10 and max(hot) <= 60 and sum(hot) == sum(r[3] == 0 for r in data)


def test_hot_key_of_one_instant(spark, small):
    """Rows of one instant are never parted; null times come first; a key that is null is laid out whole."""
    data = [(0, i, "u", 0, i % 3, None, 7) for i in range(100)] + [(0, 200 + i, "u", 0, i % 2, None, i) for i in range(100)]
    assert rows(h.record(spark.createDataFrame(data, CHANGES), KEYS, DATA)) == plain(data)
    nulls = [(0, i, "u", None, i, None, i) for i in range(100)]
    assert rows(h.record(spark.createDataFrame(nulls, CHANGES), KEYS, DATA)) == plain(nulls)
    late = [(0, 1, "c", 0, 5, None, None)] + [(0, 10 + i, "u", 0, i, None, i) for i in range(100)]
    found = rows(h.record(spark.createDataFrame(late, CHANGES), KEYS, DATA))
    assert len(found) == 101 and (0, 5, None, None, 0, False, False) in found


def test_empty_and_not_hot(spark, small):
    assert rows(h.record(spark.createDataFrame([], CHANGES), KEYS, DATA)) == []
    data = make(30, 3)
    assert rows(h.record(spark.createDataFrame(data, CHANGES), KEYS, DATA)) == plain(data)


@pytest.mark.parametrize("hot", [40, 10**9])
def test_as_of_probes(spark, small, monkeypatch, hot):
    """Probes of keys that are hot, absent and null, before, between and behind versions, and twice the same."""
    monkeypatch.setattr(h, "HOT_ROWS", hot)
    data, r = make(900, 2), random.Random(5)
    versions = plain(data)
    asked = [(r.choice([0, 0, 1, 2, 99]), r.randrange(-5, 500), "p") for _ in range(400)] + [(None, 4, "p"), (0, None, "p"), (0, 7, "p"), (0, 7, "p")]
    probes = spark.createDataFrame(asked, "k long, at long, tag string")
    got = h.as_of_probes(spark.createDataFrame(versions, "k long, x long, y string, valid_from long, valid_to long, is_current boolean, is_deleted boolean"), probes, KEYS, "at")
    assert got.columns == ["k", "at", "tag", "x", "y", "valid_from", "valid_to", "is_current", "is_deleted"]
    want = []
    for k, at, tag in asked:
        hit = [v for v in versions if v[0] == k and at is not None and v[3] <= at and (v[4] is None or at < v[4])]
        assert len(hit) <= 1
        want.append((k, at, tag, *(hit[0][1:] if hit else [None] * 6)))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)


def table(spark, tmp_path, name="history"):
    return HistoryTable(spark, f"{tmp_path}/{name}", KEYS, DATA, "k long, x long, y string", buckets=4)


def batches(data, size):
    return [data[i : i + size] for i in range(0, len(data), size)]


def test_batches_with_late_changes(spark, tmp_path):
    """Whatever the batches, the history is that of the whole log; repeated changes and null keys make no version."""
    data = make(240, 4)
    t = table(spark, tmp_path)
    for n, b in enumerate(batches(data, 80)):
        t.add(spark.createDataFrame([*b, b[0], (0, 999, "c", None, 1, None, 1)], CHANGES), n)
    assert rows(t.read()) == plain(data)
    t.add(spark.createDataFrame(data[:80], CHANGES), 2)  # a number that is there
    t.add(spark.createDataFrame([], CHANGES), 3)
    assert rows(t.read()) == plain(data)


def test_in_order_batches_read_open_states_alone(spark, tmp_path):
    """The log's folder is away while batches without late changes are added; only a late one needs it."""
    data = sorted(make(200, 6), key=lambda r: r[6])
    data = [(p, pos, op, k, x, y, i) for i, (p, pos, op, k, x, y, _) in enumerate(data)]
    t = table(spark, tmp_path)
    for n, b in enumerate(batches(data, 50)):
        t.add(spark.createDataFrame(b, CHANGES), n)
        os.rename(f"{tmp_path}/history/log", f"{tmp_path}/log{n}")
    assert rows(t.read()) == plain(data)
    os.makedirs(f"{tmp_path}/history/log")
    for n in range(4):
        os.rename(f"{tmp_path}/log{n}/batch={n}", f"{tmp_path}/history/log/batch={n}")
    late = [(0, 5000, "u", 0, 77, "late", 100), (0, 5001, "d", 1, None, None, -1)]
    t.add(spark.createDataFrame(late, CHANGES), 4)
    assert rows(t.read()) == plain(data + late)


def test_stopped_before_open_states(spark, tmp_path, monkeypatch):
    """A batch that stops behind its versions is completed by its second run."""
    data = make(160, 7)
    t = table(spark, tmp_path)
    first, second = batches(data, 80)
    t.add(spark.createDataFrame(first, CHANGES), 0)
    merge = t.open.merge

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(t.open, "merge", stop)
    with pytest.raises(OSError):
        t.add(spark.createDataFrame(second, CHANGES), 1)
    monkeypatch.setattr(t.open, "merge", merge)
    t.add(spark.createDataFrame(second, CHANGES), 1)
    assert rows(t.read()) == plain(data)


def test_history_as_a_stream(spark, tmp_path):
    """A batch's own versions are what it writes: parts of other keys' buckets stay."""
    path = f"{tmp_path}/in"
    data = [(0, i, "c", i, 1, None, i) for i in range(1, 40)], [(0, 50, "u", 3, 9, None, 50)]
    for b in data:
        spark.createDataFrame(b, CHANGES).coalesce(1).write.mode("append").parquet(path)
    t = table(spark, tmp_path)
    t.start(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(path), f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(t.read()) == plain(data[0] + data[1])
    written = spark.read.parquet(f"{tmp_path}/history/versions/data/v1/delta")
    assert written.count() == 2 and written.where(F.col("k") != 3).isEmpty()
