"""Tables of a lake kept as Parquet in buckets of their key.

A bucket is a run of parts: a base of whole rows and, behind it, deltas of what batches changed (rows, and keys that were
deleted), each with the batch's version. A merge writes a delta of the batch alone; readers take the newest row of a
key. In turn, an eighth of the buckets at each merge, parts are folded: always the shortest run of last parts that is no
less than half of the part before it, so a bucket has few parts, each row is written anew a logarithmic number of times,
and what a batch writes does not grow with the table.

Buckets grow by linear hashing: once the table has more rows than its buckets should hold, the next bucket in line is
split in two, and no other bucket moves. The schema may grow too: a column that is new or wider is written into the
manifest, and older parts are read under it.

A version's manifest names the parts of each bucket. It is the last thing that a merge writes, so a batch that fails half-way
leaves no trace, and one that is replayed finds its manifest and does nothing. Manifests are small JSON files, read and
written through Hadoop's file systems, so any store will do; only the newest few are kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import apply
from .scratch import empty

#: Rows of a bucket, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 16
#: Merges from one turn of a bucket to the next, and manifests that are kept.
TURN, KEPT = 8, 10
OWN = [T.StructField("_deleted", T.BooleanType()), T.StructField("_version", T.LongType())]
#: Types that older parts may be read as.
WIDER = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp_ntz",)}


@dataclass
class State:
    """What a manifest says. parts: for each bucket (folder, rows) in order; first: the number of buckets at the beginning."""

    version: int
    schema: T.StructType
    first: int = 0
    buckets: int = 0
    parts: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    def rows(self) -> int:
        return sum(n for parts in self.parts.values() for _, n in parts)


def is_base(folder: str) -> bool:
    return "/base/" in folder


class LakeTable:
    """keys: key columns; schema: all columns at the beginning; buckets: how many at first, else by the size of the first batch.

    Columns whose names begin with `_deleted`, `_version` or `_bucket` are the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int | None = None):
        self.spark, self.path, self.keys, self.wanted = spark, path.rstrip("/"), keys, buckets
        self.initial = T._parse_datatype_string(schema)
        self._read: dict[str, dict] = {}

    # ------------------------------------------------------------ files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    # ------------------------------------------------------------ manifests

    def _manifest(self, name: str) -> dict | None:
        """A manifest's content, null if it was not written to its end."""
        fs, p = self._fs(f"{self.path}/manifests/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def state(self) -> State:
        """The newest whole manifest; one that was not written to its end is none."""
        root = f"{self.path}/manifests"
        for name in reversed(self._names(root)):
            if name not in self._read:
                found = self._manifest(name)
                if found is None:
                    continue
                self._read = {name: found}
            m = self._read[name]
            parts = {int(b): [(f, n) for f, n in p] for b, p in m["parts"].items()}
            return State(m["version"], T.StructType.fromJson(m["schema"]), m["first"], m["buckets"], parts)
        return State(-1, self.initial)

    def manifest(self) -> tuple[int, int, dict[int, int]]:
        """(version, number of buckets, the version that wrote each bucket last)."""
        s = self.state()
        return s.version, s.buckets, {b: int(parts[-1][0].split("/")[0][1:]) for b, parts in s.parts.items() if parts}

    def version(self) -> int:
        return self.state().version

    def _publish(self, s: State) -> None:
        m = {"version": s.version, "first": s.first, "buckets": s.buckets, "schema": s.schema.jsonValue(), "parts": {b: p for b, p in s.parts.items() if p}}
        root = f"{self.path}/manifests"
        fs, p = self._fs(f"{root}/v{s.version:012d}.json")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(m).encode()))
        finally:
            stream.close()
        for name in self._names(root)[:-KEPT]:
            fs.delete(self._fs(f"{root}/{name}")[1], True)

    def vacuum(self) -> int:
        """Delete data that the kept manifests don't name: what was folded, and what failed batches left. How many folders went."""
        root, named, gone = f"{self.path}/manifests", set(), 0
        for name in self._names(root):
            named |= {f.split("/")[0] for part in (self._manifest(name) or {"parts": {}})["parts"].values() for f, _ in part}
        for name in self._names(f"{self.path}/data"):
            if name not in named and int(name[1:]) <= self.version():
                fs, p = self._fs(f"{self.path}/data/{name}")
                gone += bool(fs.delete(p, True))
        return gone

    # ------------------------------------------------------------ buckets

    def bucket(self, buckets: int, first: int | None = None) -> Column:
        """The bucket of a row. `first` buckets have been doubled as often as went, and those before the split line once more."""
        level = first or buckets
        while level * 2 <= buckets:
            level *= 2
        h = F.xxhash64(*self.keys)
        low = F.pmod(h, F.lit(level))
        return F.when(low < buckets - level, F.pmod(h, F.lit(2 * level))).otherwise(low).cast("int")

    def _line(self, s: State) -> int:
        """The bucket that is split next."""
        level = s.first
        while level * 2 <= s.buckets:
            level *= 2
        return s.buckets - level

    def touched(self, rows: DataFrame) -> tuple[int, list[int]]:
        """(number of buckets, those that the rows' keys fall into)."""
        s = self.state()
        buckets, first = (s.buckets, s.first) if s.buckets else [self._first(rows)] * 2
        return buckets, [r[0] for r in rows.select(self.bucket(buckets, first).alias("b")).distinct().collect()]  # at most `buckets` rows

    def _first(self, rows: DataFrame) -> int:
        return self.wanted or max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))

    # ------------------------------------------------------------ reading

    def _versions(self, s: State, folders: list[str]) -> DataFrame:
        """Rows of parts with _deleted and _version; those of a base are older than any delta's."""
        root = f"{self.path}/data"
        bases, deltas = [f"{root}/{f}" for f in folders if is_base(f)], [f"{root}/{f}" for f in folders if not is_base(f)]
        found = []
        if bases:
            found.append(self.spark.read.schema(s.schema).parquet(*bases).withColumns({"_deleted": F.lit(False), "_version": F.lit(-1).cast("long")}))
        if deltas:
            found.append(self.spark.read.schema(T.StructType([*s.schema.fields, *OWN])).parquet(*deltas))
        return reduce(DataFrame.unionByName, found) if found else empty(self.spark, T.StructType([*s.schema.fields, *OWN]))

    def _newest(self, versions: DataFrame) -> DataFrame:
        rest = [c for c in versions.columns if c not in self.keys]
        return versions.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row")).select(*self.keys, "_row.*").select(*versions.columns)

    def _rows(self, s: State, only: list[int] | None = None) -> DataFrame:
        names = [f.name for f in s.schema.fields]
        held = {b: [f for f, _ in p] for b, p in s.parts.items() if p and (only is None or b in only)}
        plain = [f for p in held.values() if len(p) == 1 and is_base(p[0]) for f in p]
        mixed = [f for p in held.values() if not (len(p) == 1 and is_base(p[0])) for f in p]
        out = self._versions(s, plain).select(*names)
        return out.unionByName(self._newest(self._versions(s, mixed)).where("not _deleted").select(*names)) if mixed else out

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets. Only keys of buckets that have deltas are shuffled."""
        return self._rows(self.state(), only)

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, out: str, s: State) -> dict[int, int]:
        """Write rows by buckets under data/out; how many each bucket got, from the files' footers."""
        path = f"{self.path}/data/{out}"
        rows.withColumn("_bucket", self.bucket(s.buckets, s.first)).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        if not any(n.startswith("_bucket=") for n in self._names(path)):
            return {}
        return {int(r["_bucket"]): r["n"] for r in self.spark.read.schema("_bucket int").parquet(path).groupBy("_bucket").agg(F.count("*").alias("n")).collect()}

    def replace(self, rows: DataFrame, buckets: int, touched: list[int], version: int) -> None:
        """Write rows as the whole new content of the touched buckets, then the manifest. Large buckets are several files."""
        s = self.state()
        s.version, s.buckets, s.first = version, buckets, s.first or buckets
        sizes = self._write(rows.select(*[F.col(f.name).cast(f.dataType) for f in s.schema.fields]), f"v{version}/base", s)
        for b in touched:
            s.parts[b] = [(f"v{version}/base/_bucket={b}", sizes[b])] if b in sizes else []
        self._publish(s)

    def _grown(self, s: State, rows: DataFrame, data: list[str]) -> T.StructType:
        """The schema with the batch's new columns, and with columns widened where the batch has a wider type."""
        known = {f.name: f for f in s.schema.fields}
        for name in data:
            new = rows.schema[name].dataType
            if name not in known:
                known[name] = T.StructField(name, new)
            elif new.simpleString() in WIDER.get(known[name].dataType.simpleString(), ()):
                known[name] = T.StructField(name, new)
        return T.StructType(list(known.values()))

    def _due(self, s: State, version: int, splits: int) -> tuple[list[str], dict[int, int]]:
        """(folders to fold, from which part on in each bucket): buckets to split whole, and those whose turn it is."""
        first = {self._line(s) + i: 0 for i in range(splits)}
        for b, parts in s.parts.items():
            if b in first or (b + version) % TURN or len(parts) < 2:
                continue
            at, total = len(parts) - 1, parts[-1][1]
            while at and parts[at - 1][1] < 2 * total:
                at -= 1
                total += parts[at][1]
            if at < len(parts) - 1:
                first[b] = at
        return [f for b, at in first.items() for f, _ in s.parts.get(b, [])[at:]], first

    def merge(self, changes: DataFrame, data: list[str], version: int, order: str = "last_wins") -> bool:
        """Apply a batch of changes as `version`; False if that version or a later one is there already.

        data: the columns that changes carry, new ones among them; what the table has besides is null in rows that the
        batch writes. Of a key the last change wins, or with order deletes_first any upsert.
        """
        s = self.state()
        if version <= s.version:
            return False
        fresh_table = not s.buckets
        if fresh_table:
            s.first = s.buckets = self._first(changes)
        good, _ = apply.missing_key(changes, self.keys)
        if order == "last_wins":
            last = apply.latest_per_key(good, self.keys).where("op is not null")  # one pass for rows and for deleted keys
        else:
            upserts, removed = apply.survivors(good, self.keys, order)
            last = upserts.unionByName(removed.join(upserts.select(*self.keys), self.keys, "left_anti").withColumn("op", F.lit("d")), allowMissingColumns=True)
        s.schema = self._grown(s, last, data)
        gone = F.col("op") == "d"
        cell = lambda f: (F.col(f.name) if f.name in self.keys else F.when(~gone, F.col(f.name)) if f.name in data else F.lit(None)).cast(f.dataType).alias(f.name)
        cells = [cell(f) for f in s.schema.fields]
        rows = last.where(~gone).select(*cells) if fresh_table else last.select(*cells, gone.alias("_deleted"), F.lit(version).cast("long").alias("_version"))
        # as many splits as the table's rows ask for, but no more than keep up with batches that add to it
        behind = -(-s.rows() // BUCKET_ROWS) - s.buckets
        splits = max(0, min(behind, self._level(s) - self._line(s), 2 + 2 * s.rows() // (BUCKET_ROWS * max(1, s.buckets))))
        folders, folded = self._due(s, version, splits)
        s.version, s.buckets = version, s.buckets + splits
        kind = "base" if fresh_table else "delta"
        fresh = self._write(rows, f"v{version}/{kind}", s)
        if folders:
            self._fold(s, folders, folded)
        for b, n in fresh.items():
            s.parts.setdefault(b, []).append((f"v{version}/{kind}/_bucket={b}", n))
        self._publish(s)
        return True

    def _level(self, s: State) -> int:
        return s.buckets - self._line(s)

    def _fold(self, s: State, folders: list[str], first: dict[int, int]) -> None:
        """Write the newest rows of some parts as one part for each bucket: a base where all parts are folded, else a delta."""
        version = s.version
        newest = self._newest(self._versions(s, folders)).withColumn("_at", self.bucket(s.buckets, s.first))
        names = [f.name for f in s.schema.fields]
        # a bucket that a split has made belongs to those that are folded whole
        whole = [b for b, at in first.items() if at == 0]
        partial = [b for b, at in first.items() if at > 0]
        bases = self._write(newest.where(~F.col("_at").isin(partial) & ~F.col("_deleted")).select(*names), f"v{version}/base", s) if whole else {}
        deltas = self._write(newest.where(F.col("_at").isin(partial)).drop("_at"), f"v{version}/folded", s) if partial else {}
        for b in whole:
            s.parts[b] = []
        for b, n in bases.items():
            s.parts[b] = [(f"v{version}/base/_bucket={b}", n)]
        for b in partial:
            s.parts[b] = s.parts[b][: first[b]] + ([(f"v{version}/folded/_bucket={b}", deltas[b])] if b in deltas else [])
