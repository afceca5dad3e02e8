"""N-gram Jaccard join by universe partition and pigeonhole.

A text is the set of its word n-gram hashes. Sets fall into size bands so narrow that linked sets lie in one band or in
two neighbours. Two linked sets whose smaller one is in a band differ in at most H tokens, so after the token universe
is hashed into segments, some segment differs by no more than its share: with e_i = 0 (equal subsets) or 1 (one
deletion) and the sum of (e_i + 1) above H, at least one segment differs by e_i tokens or fewer. Each set is indexed by
its segment subsets and, in one-deletion segments, by those subsets less one token each. How many segments are of
which kind is chosen for each band by cost: rows to shuffle against chance meetings among the band's sets.

Candidates are then verified exactly on the texts. Equal sets are one class from the start. Within a bucket each class
is first verified against the class it meets most often as a bucket's smallest; what that links is one component. Only
buckets that still hold several components go on: pairs across components that parity sketches cannot rule out are
verified, nearest first, in rounds until none is left. So a group of n near copies costs about n verifications, and no
link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, doc_chunks, lower_ascii, materialize, materialize_in_turn, mix64, prefix_sums, shuffles_removed, span_hash, whole_row, word_spans
from .components import connected_components

#: Costs in index rows: of a row in a bucket where sets meet by chance, and of a comparison of two such sets' sketches.
MET_COST, PAIR_COST = 3.0, 0.02
#: Share of tokens that two unlinked sets of a band are taken to have in common, for the cost estimate only.
OVERLAP = 0.05
#: Untested neighbours of a class that a bucket sends on in the first round; four times as many in each later one.
NEAREST = 4
#: Index keys keep 48 bits: the zero bytes compress, and keys that meet by chance are verified like any other.
KEY_MASK = np.uint64((1 << 48) - 1)
#: A bucket with more classes that are still apart is dealt out again by independent partitions, DEALS - 1 times at most;
#: what is crowded then, as its sets are alike throughout, is cut into blocks, and each pair of blocks is a bucket.
CROWD, DEALS = 2048, 4
#: What a shuffle by buckets may hold, in rows and bytes for each token of all sets (a token is some 4 bytes of packed input),
#: and in rows and bytes at least; what is more goes in several turns, each with a share of the buckets.
ROWS_A_TOKEN, BYTES_A_TOKEN, LEAST_ROWS, LEAST_BYTES = 0.6, 4, 1 << 24, 1 << 28


# ---------------------------------------------------------------- sets


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct word n-gram hashes of each text; a text of fewer words is one gram, of no words an empty set."""
    low = lower_ascii(buf)
    s, e, doc = word_spans(low, bounds)
    words = span_hash(prefix_sums(low), s, e)
    first = np.searchsorted(doc, np.arange(len(bounds)))
    grams = words
    for j in range(1, n):
        grams = mix64(grams[: len(words) - j] * np.uint64(0xD6E8FEB86659FD93) + words[j:]) if len(words) > j else words[:0]
    out = []
    for i in range(len(bounds) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(h)
        else:
            out.append(words[:0])
    return out


def set_hash(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


def _sets_of(batch: pa.RecordBatch, col: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    buf, off = byte_column(batch.column(col))
    for i, j in doc_chunks(off):
        for d, x in enumerate(shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)):
            yield i + d, x


def _classes(n: int):
    def run(batches):
        for batch in batches:
            size, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, x in _sets_of(batch, 1, n):
                size[i], cls[i] = len(x), set_hash(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(cls)], ["k", "id", "n", "c"])

    return run


# ---------------------------------------------------------------- bands and segments


class Bands:
    """Size bands for the threshold num / den, with the number of segments of each kind."""

    def __init__(self, num: int, den: int, largest: int, counts: dict[int, int] | None = None):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(self.low[-1] * den // num + 1)
        self.edges = np.array(self.low)
        self.plan = [self._allocate(k, (counts or {}).get(k, 0) + (counts or {}).get(k + 1, 0)) for k in range(len(self.low) - 1)]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def partners(self, k: int) -> int:
        """Largest set that links with one of band k."""
        return (self.low[k + 1] - 1) * self.den // self.num

    def difference(self, k: int) -> int:
        """Most tokens in which linked sets differ whose smaller one is in band k."""
        s = self.low[k + 1] - 1
        return (self.den - self.num) * (s + self.partners(k)) // (self.den + self.num)

    def rows(self, k: int, size: float) -> float:
        """Index rows in band k of a set of that size, on average."""
        exact, one = self.plan[k]
        return exact + one + size * one / (exact + one)

    def _allocate(self, k: int, sets: int) -> tuple[int, int]:
        """Exact and one-deletion segments, the cheapest mix that covers the difference."""
        need, size = self.difference(k) + 1, (self.low[k] + self.low[k + 1]) / 2

        def cost(exact: int, one: int) -> float:
            # unlinked sets meet in a segment where neither has tokens of its own, or, with one deletion, one token
            c = size / (exact + one)
            own = c * (1 - OVERLAP)
            alone, pair = math.exp(-own), math.exp(-2 * own)
            met = exact * min(alone, sets * pair) + one * min(alone * (1 + own), sets * pair * (1 + 2 * own))
            pairs = sets * pair * (exact + one * (1 + 2 * own))
            return exact + one * (1 + c) + MET_COST * met + PAIR_COST * pairs

        plans = [(need - 2 * one, one) for one in range(need // 2 + 1)]
        if need % 2:  # an odd rest may be covered by one more one-deletion segment
            plans.append((0, need // 2 + 1))
        return min(plans, key=lambda p: cost(*p))


def signatures(x: np.ndarray, bands: Bands, seed: int) -> np.ndarray:
    """Index keys of a set: for its own band and, where it may be the larger partner, the band below."""
    own = bands.band(len(x))
    with np.errstate(over="ignore"):
        value = mix64(x ^ np.uint64(0xA0761D6478BD642F))
        place = mix64(x + np.uint64(seed) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(17)) >> np.uint64(32)
        out = []
        for k in (own, own - 1):
            if k < 0 or len(x) > bands.partners(k):
                continue
            exact, one = bands.plan[k]
            m = exact + one
            seg = (place * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, seg, value)
            tag = mix64(np.arange(m, dtype=np.uint64) + np.uint64((k * 1_000_003 + seed) << 20))
            out.append(mix64(total ^ tag) + tag)
            if one:
                cut = seg >= exact
                s = seg[cut]
                out.append(mix64((total[s] - value[cut]) ^ tag[s]) + tag[s])
    return np.unique(np.concatenate(out))


def _index(n: int, bands: Bands, seed: int, turn: int = 0, turns: int = 1):
    """(key, class) of each set, of keys whose turn it is; copies of a set within a task are indexed once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, classes, held = [], [], 0
            for _, x in _sets_of(batch, 0, n):
                c = set_hash(x)
                if not len(x) or c in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                sig = signatures(x, bands, seed) & KEY_MASK
                if turns > 1:
                    sig = sig[sig % np.uint64(turns) == np.uint64(turn)]
                keys.append(sig)
                classes.append(np.full(len(sig), c, np.int64))
                held += len(sig)
                if held > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(classes)), pa.array(np.concatenate(keys).view(np.int64))], ["c", "b"])
                    keys, classes, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(classes)), pa.array(np.concatenate(keys).view(np.int64))], ["c", "b"])

    return run


def _reindex(n: int, bands: Bands, seed: int):
    """Members of a crowded bucket, to its sub-buckets under another partition; linked members still meet in one."""

    def run(batches):
        for batch in batches:
            bucket, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, classes = [], []
            for i, x in _sets_of(batch, 2, n):
                sig = signatures(x, bands, seed)
                keys.append(mix64(sig ^ mix64(bucket[i : i + 1].view(np.uint64))))
                classes.append(np.full(len(sig), cls[i], np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], ["b", "c"])

    return run


def _meetings(batches):
    """Rows sorted by bucket and class, all of a bucket in this task, to a row per class of the buckets where classes
    meet, with the bucket's smallest class. Two rows at most are carried from batch to batch."""
    b = c = np.zeros(0, np.int64)  # carried: the last bucket's smallest class and, once they are sent, its largest
    for batch in batches:
        sent = len(b) if len(b) > 1 else 0
        b, c = np.concatenate([b, batch.column(0).to_numpy()]), np.concatenate([c, batch.column(1).to_numpy()])
        if not len(b):
            continue
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        b, c = b[new], c[new]
        head = np.ones(len(b), bool)
        head[1:] = b[1:] != b[:-1]
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(b)))
        meet = np.repeat(size > 1, size)
        meet[:sent] = False
        lead = np.repeat(c[at], size)
        if meet.any():
            yield pa.RecordBatch.from_arrays([pa.array(b[meet]), pa.array(c[meet]), pa.array(lead[meet])], ["b", "c", "lead"])
        keep = [at[-1], len(b) - 1] if size[-1] > 1 else [at[-1]]
        b, c = b[keep], c[keep]


# ---------------------------------------------------------------- verification


def _verify(n: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            left = dict(_sets_of(batch, 2, n))
            ok = np.zeros(batch.num_rows, bool)
            for i, y in _sets_of(batch, 3, n):
                x = left[i]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["u", "v", "linked"])

    return run


def sketch(x: np.ndarray) -> bytes:
    """Parities of the tokens hashed to each bit; sketches of two sets differ in no more bits than the sets in tokens."""
    bits = 256
    while bits < 2 * len(x) and bits < 1 << 16:
        bits *= 2
    h = (mix64(x ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(h, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(s.reshape(-1, words), axis=0)


def _sketches(n: int):
    def run(batches):
        for batch in batches:
            size, out = [0] * batch.num_rows, [b""] * batch.num_rows
            for i, x in _sets_of(batch, 1, n):
                size[i], out[i] = len(x), sketch(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["c", "n", "sketch"])

    return run


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter one's size."""
    x, y, nx, ny = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while nx > ny:
        nx //= 2
        x = (x >> 8 * nx) ^ (x & ((1 << 8 * nx) - 1))
    while ny > nx:
        ny //= 2
        y = (y >> 8 * ny) ^ (y & ((1 << 8 * ny) - 1))
    return (x ^ y).bit_count()


def _plausible(num: int, den: int, nearest: int):
    """Rows of a bucket (sorted by bucket) to pairs across components that may link: each class's next nearest ones.

    A row says how far down its neighbours (by bits apart, then by class) its class has come; nearer pairs have been
    tested. Pairs come back without a bucket. A bucket that has more of them comes back with all its rows and how far
    each is now; all others are settled by their pairs.
    """

    def few(rows):
        for i, (c, comp, n, sk, *_) in enumerate(rows):
            for d, pcomp, m, other, *_ in rows[i + 1 :]:
                if comp != pcomp and den * min(n, m) >= num * max(n, m) and _apart(sk, other) * (den + num) <= (den - num) * (n + m):
                    yield min(c, d), max(c, d), None, 0

    def many(rows, b):
        c, comp, size = (np.array([r[k] for r in rows]) for k in range(3))
        words = [np.frombuffer(r[3], np.uint64) for r in rows]
        width = min(map(len, words))
        flat = np.array([_folded(s, width) for s in words])
        more, reached = False, []
        for i, (own, _, _, _, far, last) in enumerate(rows):
            s, t = np.minimum(size[i], size), np.maximum(size[i], size)
            j = np.flatnonzero((comp != comp[i]) & (den * s >= num * t))
            apart = np.bitwise_count(flat[j] ^ flat[i]).sum(axis=1, dtype=np.int64)
            ok = (apart * (den + num) <= (den - num) * (s + t)[j]) & ((apart > far) | ((apart == far) & (c[j] > last)))
            j, apart = j[ok], apart[ok]
            order = np.lexsort((c[j], apart))
            for x in order[:nearest]:
                yield min(own, int(c[j[x]])), max(own, int(c[j[x]])), None, 0
                far, last = int(apart[x]), int(c[j[x]])
            more |= len(order) > nearest
            reached.append((own, last, b, far))
        if more:
            yield from reached

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["u", "v", "b", "far"])

    def run(batches):
        rows: list = []
        found: list = []
        now = None
        for batch in batches:
            b, *cols = (col.to_pylist() for col in batch.columns)
            for bucket, *row in zip(b, *cols, strict=True):
                if bucket != now and rows:
                    found += few(rows) if len(rows) <= 4 else many(rows, now)
                    rows = []
                    if len(found) > 10_000:
                        yield out(found)
                        found = []
                now = bucket
                rows.append(row)
        if rows:
            found += few(rows) if len(rows) <= 4 else many(rows, now)
        if found:
            yield out(found)

    return run


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Buckets (b, c, size) cut into blocks of classes by hash, to a bucket for each pair of blocks: every two classes
    of a bucket meet in one at least, and none holds much more than half of CROWD."""
    blocks = F.ceil(F.col("size") * 4 / CROWD).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64(F.col("b"), F.least(own, x.cast("long")), F.greatest(own, x.cast("long"))))
    return rows.select(F.explode(pairs).alias("b"), "c")


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Link texts whose word n-gram sets have den * intersection >= num * union; group what links connect.

    Returns per row: id_col, n_shingles (size of its set), component_id (smallest id reachable by links, its own
    included), class_id (equal for equal sets), group_id (equal for what links connect) and row_key (of id and text). A text with no words, an empty or a null one has no links; rows with
    equal texts link whatever their ids; a null id takes part, and is only returned as component_id where it is alone.
    Other columns are not read. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"))
    members = materialize(rows.mapInArrow(_classes(words), f"k long, id {id_type}, n long, c long"), "sets")
    sized = members.where("n > 0")
    largest = sized.agg(F.max("n")).first()[0] or 1
    outline = Bands(num, den, largest)
    edges = [int(x) for x in outline.low]
    # one row for each band: as many as the logarithm of the largest set
    per_band = sized.groupBy(F.expr(f"size(filter(array({','.join(map(str, edges))}), x -> x <= n)) - 1").cast("int").alias("band")).agg(F.approx_count_distinct("c").alias("sets"), F.count("*").alias("rows"), F.sum("n").alias("tokens")).collect()
    bands = Bands(num, den, largest, {r["band"]: r["sets"] for r in per_band})

    meet = "b long, c long, lead long"
    tokens = sum(r["tokens"] for r in per_band)
    most_rows, most_bytes = max(LEAST_ROWS, ROWS_A_TOKEN * tokens), max(LEAST_BYTES, BYTES_A_TOKEN * tokens)
    # a set is in its own band and, as nearly all may be the larger partner, in the one below
    indexed = sum(r["rows"] * bands.rows(k, r["tokens"] / r["rows"]) for r in per_band for k in (r["band"], r["band"] - 1) if k >= 0)
    turns = max(1, math.ceil(indexed / most_rows))

    def meetings(index: DataFrame) -> DataFrame:
        return index.select("b", "c").repartition("b").sortWithinPartitions("b", "c").mapInArrow(_meetings, meet)

    def shares(still: DataFrame, n: int) -> list[DataFrame]:
        """Rows of buckets in n parts, each with whole buckets."""
        return [still.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i) for i in range(n)] if n > 1 else [still]

    buckets = materialize_in_turn((meetings(rows.select("text").mapInArrow(_index(words, bands, 0, i, turns), "c long, b long")) for i in range(turns)), "buckets")
    met = buckets.select("c").distinct()
    reps = members.groupBy("c").agg(F.min("k").alias("k")).join(met, "c")
    # repeated rows lie in one task by k, so they go without another shuffle of the texts
    texts = materialize(rows.select("k", "text").join(reps, "k").dropDuplicates(["k", "c"]).select("c", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("u", "ut"), "u").join(texts.toDF("v", "vt"), "v").select("u", "v", "ut", "vt")
        return materialize(both.mapInArrow(_verify(words, num, den), "u long, v long, linked boolean"), "verified")

    often = buckets.where("c <> lead").groupBy("c", "lead").count()
    stars = often.groupBy("c").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    tested = verified(stars.select(F.col("lead").alias("u"), F.col("c").alias("v")))
    start = [F.lit(-1).cast("long").alias("far"), F.lit(0).cast("long").alias("last")]
    still = buckets.select("b", "c", *start)
    sketches = None
    deals, nearest = 1, NEAREST
    while True:
        comps = connected_components(tested.where("linked").select("u", "v"))
        named = still.join(comps.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
        apart = named.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        still = materialize(named.join(apart.select("b", "size"), "b"), "apart")
        crowded = still.where(F.col("size") > CROWD)
        if deals <= DEALS and not crowded.isEmpty():
            if deals < DEALS:
                # each of its sets is indexed anew for a row of a bucket
                n = max(1, math.ceil(crowded.count() * indexed / sum(r["rows"] for r in per_band) / most_rows))
                again = [x.join(texts, "c").select("b", "c", "text").mapInArrow(_reindex(words, bands, deals), "b long, c long") for x in shares(crowded.select("b", "c"), n)]
                again = [meetings(x) for x in again]
            else:
                again = [_block_pairs(crowded)]
            deals += 1
            kept = still.where(F.col("size") <= CROWD).select("b", "c", "far", "last")
            still = materialize_in_turn([kept, *[x.select("b", "c", *start) for x in again]], "buckets")
            continue
        if still.isEmpty():
            break
        if sketches is None:
            sketches = materialize(texts.join(still.select("c").distinct(), "c").select("c", "text").mapInArrow(_sketches(words), "c long, n long, sketch binary"), "sketches")
        # as bytes before compression: the more shuffle partitions, the less of a class's rows lie together
        with shuffles_removed(docs.sparkSession):
            held = still.join(sketches.select("c", F.octet_length("sketch").alias("bytes")), "c").agg(F.sum(F.col("bytes") + 48)).first()[0] or 0
        rich = [x.join(sketches, "c").select("b", "c", "comp", "n", "sketch", "far", "last") for x in shares(still, max(1, math.ceil(held / most_bytes)))]
        found = materialize_in_turn((x.repartition("b").sortWithinPartitions("b").mapInArrow(_plausible(num, den, nearest), "u long, v long, b long, far long") for x in rich), "pairs")
        nearest *= 4
        pairs = found.where("b is null").select("u", "v").distinct().join(tested.select("u", "v"), ["u", "v"], "left_anti")
        tested = tested.unionByName(verified(pairs))
        still = found.where("b is not null").select("b", F.col("u").alias("c"), "far", F.col("v").alias("last"))
    # tables of a row per class, written so that joins with them have nothing but shuffles below and Spark can split a
    # component or class that holds a large share of the rows
    named = members.where("n > 0").groupBy("c").agg(F.min("id").alias("own")).join(comps.withColumnRenamed("node", "c"), "c", "left")
    named = materialize(named.select("c", "own", F.coalesce("component", "c").alias("comp")), "classes")
    least = materialize(named.groupBy("comp").agg(F.min("own").alias("least")), "least")
    found = materialize(named.select("c", "comp").join(least, "comp"), "components")
    out = members.join(found, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"), F.col("c").alias("class_id"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("k")).alias("group_id"), F.col("k").alias("row_key"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all their columns, less near-duplicates: of what links connect, the row with the smallest id
    stays (a null id last), once. Rows without words stay, once for each id."""
    found = jaccard_components(docs, id_col, text_col, words, num, den)
    stay = found.groupBy("group_id").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), "row_key")).alias("m")).select(F.col("m.row_key").alias("k"))
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), whole_row(docs).alias("row"))
    # of rows equal in id and text the one whose other columns are the smallest as JSON
    rest = [F.col("row")[c].alias(str(i)) for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return keyed.join(stay, "k", "left_semi").groupBy("k").agg(F.min_by("row", order).alias("row")).select("row.*")
