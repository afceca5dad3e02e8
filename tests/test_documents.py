"""Documents, literals and cells of any length and depth, and the rules of loads and positions."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from tidelake.functions import coerce, envelope
from tidelake.operators import documents, health, load, routing


def flat(spark, texts, id_col="id"):
    d = spark.createDataFrame(list(enumerate(texts)), f"{id_col} int, t string").select(id_col, F.parse_json("t").alias("doc"))
    out = {}
    for r in documents.flatten(d, id_col, "doc").collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def test_flatten_strings_of_any_kind(spark):
    long = 'q{}"\\ ' * 200_000
    got = flat(spark, ['{"a":"x\\"}}\\"y","b":{"c":1}}', json.dumps({"s": long, "b": {"c": long}}), "[1]", "null", "{}", '{"a":{}}'])
    assert got == {0: {"a": 'x"}}"y', "b_c": "1"}, 1: {"s": long, "b_c": long}}


def test_flatten_depth(spark):
    deep = '{"a":' * 400 + "7" + "}" * 400
    assert flat(spark, [deep, '{"b":' * 12 + '{"x":1,"y":{"z":null}}' + "}" * 12]) == {0: {("a_" * 32)[:63]: "7"}, 1: {"b_" * 12 + "x": "1", "b_" * 12 + "y_z": None}}


def test_flatten_ids(spark):
    """The outermost id, else that of the first object that has one, however deep others lie."""
    texts = ['{"b":{"_id":2},"a":{"c":{"_id":{"$oid":"z"}},"_id":5}}', '{"b":{"_id":2},"_id":{"$oid":"k"}}', '{"b":{"_id":"x"},"aa":1,"a":{"B":{"_id":3}}}', '{"_id":{"x":1}}']
    assert [x["mongo_id"] for _, x in sorted(flat(spark, texts).items())] == ["5", "k", "3", '{"x":1}']


@pytest.mark.parametrize("name", ["id", "path", "name", "value", "key", "v", "doc_", "leaf", "open"])
def test_flatten_id_names(spark, name):
    assert flat(spark, ['{"id":1,"path":{"name":2}}'], name) == {0: {"id": "1", "path_name": "2"}}


def test_flatten_names(spark):
    """Paths that come to one name get suffixes, the same in each document."""
    got = flat(spark, ['{"A-b":1,"A_b":2,"__":{"9":3},"":4}', '{"A_b":5}'])
    other = next(k for k in got[1])
    assert got == {0: {"a_b": "1", other: "2", "x_9": "3", "x": "4"}, 1: {other: "5"}} and other.startswith("a_b_")


def test_long_literals_and_cells(spark):
    long = "it''s } " * 1_000_000
    rows = [f"'{long}'", "''", "'", "'it''s'", " null ", "B'0'", "x'0F'", "_binary 'ab'", "12", "-1.5e3", "1" * 500, "b'2'"]
    d = spark.createDataFrame([(x,) for x in rows], "x string").select(envelope.sql_literal(F.col("x")).alias("y")).select("y.*")
    got = [tuple(r) for r in d.collect()]
    assert got[0] == ("string", long.replace("''", "'"))
    assert got[1:] == [("string", ""), ("raw", "'"), ("string", "it's"), ("null", None), ("bool", "false"), ("bytes", "x'0F'"), ("bytes", "_binary 'ab'"), ("int", "12"), ("float", "-1.5e3"), ("raw", "1" * 500), ("raw", "b'2'")]
    cells = ["ab" * 500_000, "\\xab" * 300_000, "X'" + "0F" * 300_000 + "'", "\\x" + "0f" * 300_000, "_binary 'x'", "abc", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in cells], "x string").select(coerce.bytes_hex(F.col("x"))).collect()]
    assert got == ["ab" * 500_000, "ab" * 300_000, "0f" * 300_000, "0f" * 300_000, "78", "616263", ""]


def test_broken_patterns_are_reported(spark):
    d = spark.createDataFrame([("s", "t_1"), ("s", "x")], "s string, t string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        # the first is one of Python's alone, the second one of Java's alone
        cond = routing.table_wanted(F.col("s"), F.col("t"), [], ["(?P<a>t_.*)", r"\p{Alpha}", "(bad"])
    assert len(seen) == 2
    assert [r["t"] for r in d.where(cond).collect()] == ["t_1"]


def test_positions_follow_a_changed_id(spark):
    name = "conn_id string, source_schema string, source_table string"
    old = spark.createDataFrame([(1, "c", "s", "a", "lagging"), (2, "c", "s", "b", "failed"), (3, "d", "s", "a", "healthy")], f"catalog_id long, {name}, status string")
    now = spark.createDataFrame([(11, "c", "s", "a"), (12, "c", "s", "a"), (2, "c", "s", "b"), (4, "c", "s", "n")], f"catalog_id long, {name}")
    got = sorted((r["catalog_id"], r["source_table"], r["status"]) for r in health.seed_positions(now, old).collect())
    assert got == [(2, "b", "failed"), (3, "a", "healthy"), (4, "n", "healthy"), (12, "a", "healthy")]


def test_row_count_modes(spark):
    rows = [
        (1, 100, 100, None, 100, False), (2, 100, 99, None, 0, False), (3, 100, 99, None, 100, False),
        (4, 100, 100, 100, 60, False), (5, 100, 101, 100, 0, False),
        (6, 105, 103, 100, 100, True), (7, 100, 99, 100, 0, True), (8, 100, 106, 100, 0, True), (9, -1, 106, 100, 0, True), (10, 105, 103, 100, 0, True),
        (11, 20_000_000, 19_999_000, None, 0, False), (12, 20_000_000, 19_900_000, None, 0, False),
    ]
    d = spark.createDataFrame(rows, "catalog_id int, source_rows long, lake_rows long, baseline_rows long, rows_loaded long, reconciles boolean")
    s = "baseline_snapshot_streaming"
    want = [
        ("live_source", True, "ok", 0, None), ("live_source", False, "row_mismatch", 1, None), ("live_source", False, "lake_mismatch", -1, None),
        ("baseline_snapshot_resumed", True, "ok", 0, None), ("baseline_snapshot", False, "row_mismatch", -1, None),
        (f"{s}_resumed", True, "ok", -3, 2), (s, False, "incomplete_copy", 1, None), (s, False, "duplicate_load", 6, None), (s, False, "duplicate_load", 6, None), (s, True, "ok", -3, 2),
        ("live_source", True, "ok", 1000, None), ("live_source", False, "row_mismatch", 100_000, None),
    ]
    assert [tuple(r)[1:] for r in sorted(load.verify(d).collect())] == want


def test_skipped_messages_are_counted(spark):
    good = '{"op":"c","source_schema":"s","source_table":"t","after":{"id":1}}'
    rows = [("b", 0, i, v) for i, v in enumerate([good, None, "garbage", '{"op":"c","after":{}}', good])]
    parsed = envelope.parse(spark.createDataFrame(rows, "topic string, part int, pos long, value string"), with_skipped=True)
    assert [r["skipped"] for r in sorted(parsed.collect(), key=lambda r: r["pos"])] == [None, "tombstone", "no_envelope", "no_table", None]
    assert [tuple(r) for r in envelope.skip_counts(parsed).collect()] == [("b", 0, 5, 1, 1, 1, 3)]


def test_work_on_a_few_splits_is_spread(spark):
    """Rows of more bytes than one split holds, in one partition, come over all cores."""
    from tidelake.sources.scratch import SMALL_BYTES, estimated_bytes, spread

    rows = spark.range(0, 20_000_000, 1, 1)
    assert SMALL_BYTES < estimated_bytes(rows) < SMALL_BYTES * spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_parse_is_dealt_out_by_size(spark):
    """Messages of some 30 MB in one partition are more tasks than cores."""
    rows = spark.range(0, 1_000_000, 1, 1).select(F.lit("b").alias("topic"), F.lit(0).alias("part"), F.col("id").alias("pos"), F.lit("x").alias("value"))
    assert envelope.parse(rows, ("id",)).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_images_that_are_their_own_text(spark):
    """An image that nothing changes and one that is opened to a map give the same text and event id."""
    images = ['{"id":5,"b":[1,{"x":null}],"a":"q\\"\\n/","Z":1.50,"n":null}', '{"id":"007","a":1}', '{"id":"x7"}', '{"id":5,"é":"ü","a":1}', '{"mongo_id":{"$oid":"o1"},"id":1}', '{"a":1}', "{}", "null", "[1]"]
    rows = [("b", 0, i, '{"op":"c","source_schema":"s","source_table":"t","source":{"gtid":"g"},"after":' + x + "}") for i, x in enumerate(images)]
    rows += [("b", 0, 9, '{"op":"u","source_schema":"s","source_table":"t","source":{"gtid":"g"},"before":{"id":4,"c":2},"after":{"a":1}}'), ("b", 0, 10, '{"op":"d","source_schema":"s","source_table":"t","source":{"gtid":"g"},"before":{"id":4}}')]
    got = {r["pos"]: r for r in envelope.parse(spark.createDataFrame(rows, "topic string, part int, pos long, value string"), ("id",)).collect()}
    want = ['{"Z":1.5,"a":"q\\"\\n/","b":[1,{"x":null}],"id":5,"n":null}', '{"a":1,"id":7}', '{"id":"x7"}', '{"a":1,"id":5,"é":"ü"}', '{"id":1,"mongo_id":"o1"}', '{"a":1}', "{}", "{}", "{}", '{"a":1,"c":2,"id":4}', '{"id":4}']
    assert [got[i]["row"] for i in range(11)] == want
    assert [got[i]["event_id"].split("|", 3)[3] for i in (0, 1, 2, 3, 4, 9, 10)] == ["id=5", "id=7", 'id="x7"', "id=5", "id=1", "id=4", "id=4"]
