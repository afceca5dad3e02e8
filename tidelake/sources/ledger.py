"""Ledger of applied changes, in segments that a batch can pass over.

Each batch adds a segment: the identities of its changes in buckets of their hash, cut so that none is large, and for each
cut a Bloom filter with the least and greatest hash. A later batch first asks the filters, which are a twentieth of the
rows, and then reads those cuts alone that may hold one of its own identities; of a batch of new changes hardly any. Eight
segments of one size are merged to one of the next, and segments behind a horizon are dropped whole.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply as a
from .scratch import empty

ROWS = "catalog_id long, event_id string, digest long, h long"
FILTERS = "bucket int, cut int, lo long, hi long, n long, bits binary"
#: Buckets, identities of a cut on average, segments that are merged together, bits of an identity, and hash functions.
BUCKETS, CUT_ROWS, FAN = 16, 1 << 20, 8
BITS, HASHES = 10, 6


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Bits of identities in a filter of `size` bits: a row for each."""
    h = h.astype(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    low, step = mixed & np.uint64(0xFFFFFFFF), (mixed >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def _filter(key, table):
    h = table["h"].to_numpy()
    bits = np.zeros(max(64, BITS * len(h)), bool)
    bits[_places(h, len(bits))] = True
    schema = pa.schema([("bucket", pa.int32()), ("cut", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
    return pa.table({"bucket": [key[0].as_py()], "cut": [key[1].as_py()], "lo": [int(h.min())], "hi": [int(h.max())], "n": [len(h)], "bits": [np.packbits(bits).tobytes()]}, schema=schema)


def _ask(_, filters, asked):
    """Which cuts of a bucket may hold one of the hashes that are asked for."""
    h = np.sort(asked["h"].to_numpy())
    hit = []
    for f in filters.to_pylist():
        mine = h[np.searchsorted(h, f["lo"]) : np.searchsorted(h, f["hi"], side="right")]
        size = max(64, BITS * f["n"])
        bits = np.frombuffer(f["bits"], np.uint8)
        p = _places(mine, size)
        if len(mine) and ((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1).any():
            hit.append((f["segment"], f["bucket"], f["cut"]))
    schema = pa.schema([("segment", pa.string()), ("bucket", pa.int32()), ("cut", pa.int32())])
    return pa.table([pa.array([x[i] for x in hit], t) for i, t in enumerate([pa.string(), pa.int32(), pa.int32()])], schema=schema)


class Ledger:
    """Segments at path are named by the first and last batch that they hold."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def segments(self, before: int | None = None) -> dict[str, tuple[int, int]]:
        """Whole segments of batches before one, and of those that a merge has taken over only the merged one."""
        fs, p = self._fs(self.path)
        found = {}
        for x in fs.listStatus(p) if fs.exists(p) else []:
            name = x.getPath().getName()
            m = re.fullmatch(r"s(\d+)-(\d+)", name)
            if m and (before is None or int(m[2]) < before) and fs.exists(self._fs(f"{self.path}/{name}/filters/_SUCCESS")[1]):
                found[name] = (int(m[1]), int(m[2]))
        inside = lambda x, y: x != y and y[0] <= x[0] and x[1] <= y[1]
        return {n: s for n, s in found.items() if not any(inside(s, other) for other in found.values())}

    @staticmethod
    def keyed(changes: DataFrame) -> DataFrame:
        return a.ledger_rows(changes).withColumn("h", F.xxhash64(*a.IDENTITY))

    def _write(self, rows: DataFrame, name: str) -> None:
        cuts = max(1, math.ceil(rows.count() / (BUCKETS * CUT_ROWS)))
        dealt = rows.withColumns({"bucket": F.pmod("h", F.lit(BUCKETS)).cast("int"), "cut": F.pmod(F.shiftright("h", 8), F.lit(cuts)).cast("int")})
        out = f"{self.path}/{name}"
        dealt.hint("rebalance", "bucket", "cut").write.mode("overwrite").partitionBy("bucket", "cut").parquet(f"{out}/rows")
        # a task for a cut at most; what they give is small, and then dealt to few files
        dealt.select("bucket", "cut", "h").groupBy("bucket", "cut").applyInArrow(_filter, FILTERS).repartition(cuts).write.mode("overwrite").parquet(f"{out}/filters")

    def add(self, changes: DataFrame, batch: int) -> None:
        """Write a batch's identities (again, if they are there), then merge older segments where eight are of one size."""
        self._write(self.keyed(changes), f"s{batch}-{batch}")
        older = sorted(self.segments(batch).items(), key=lambda x: x[1])
        size = lambda s: int(math.log(s[1] - s[0] + 1, FAN) + 1e-9)
        for tier in sorted({size(s) for _, s in older}):
            run = [x for x in older if size(x[1]) == tier][:FAN]
            if len(run) == FAN:
                merged = f"s{run[0][1][0]}-{run[-1][1][1]}"
                self._write(self._rows([f"{self.path}/{n}/rows" for n, _ in run]), merged)
                for n, _ in run:
                    fs, p = self._fs(f"{self.path}/{n}")
                    fs.delete(p, True)

    def prune(self, horizon: int) -> int:
        """Drop segments whose batches are all before the horizon; how many went."""
        gone = [n for n, (_, last) in self.segments().items() if last < horizon]
        for n in gone:
            fs, p = self._fs(f"{self.path}/{n}")
            fs.delete(p, True)
        return len(gone)

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(*paths) if paths else empty(self.spark, ROWS)

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows([f"{self.path}/{n}/rows" for n in self.segments(before)])

    def may_hold(self, changes: DataFrame, before: int) -> list[str]:
        """Folders of the cuts that may hold one of the changes; a row for each cut reaches the driver."""
        names = list(self.segments(before))
        if not names:
            return []
        # the folder's name tells the segment
        filters = self.spark.read.schema(FILTERS).parquet(*[f"{self.path}/{n}/filters" for n in names]).withColumn("segment", F.regexp_extract(F.input_file_name(), r"/(s\d+-\d+)/filters/", 1))
        asked = self.keyed(changes).select("h", F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"))
        hit = filters.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_ask, "segment string, bucket int, cut int")
        return sorted(f"{self.path}/{r['segment']}/rows/bucket={r['bucket']}/cut={r['cut']}" for r in hit.collect())

    def unseen(self, changes: DataFrame, batch: int) -> DataFrame:
        """Changes, each once, that no earlier batch has applied."""
        return a.dedup(changes, self._rows(self.may_hold(changes, batch)))
