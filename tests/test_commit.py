"""The commit stream: stopped between any two steps and run again, tables held and released, and the ledger's filters."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidelake.sources.ledger import Ledger
from tidelake.streaming.commit import DLQ, STATS, Pipeline, columns_of

MESSAGE = "topic string, part int, pos long, value string"


def message(table, op, key, pos, **row):
    body = {"id": key, **row} if key is not None else row
    image = {"before": body} if op == "d" else {"after": body}
    return json.dumps({"op": op, "source_schema": "s", "source_table": table, "ts_ms": 1000 + pos, "source": {"gtid": f"g{pos}"}, **image})


def batches(spark, tmp_path, *parts):
    return [spark.createDataFrame([("b", 0, pos, value) for pos, value in part], MESSAGE) for part in parts]


def pipeline(spark, tmp_path, **more):
    catalog = spark.createDataFrame([(1, "s", "a", ["id"]), (2, "s", "b", ["id"])], "catalog_id long, schema_name string, table_name string, pk array<string>")
    return Pipeline(spark, f"{tmp_path}/{uuid.uuid4().hex}", catalog, **more)


def content(p):
    """All that a run leaves, without the numbers of batches."""
    rows = lambda df: sorted((json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect()))
    out = {f"mirror {i}": rows(p.mirror(i, ["id"]).read()) for i in (1, 2)}
    out["history"] = rows(p.history_table(1, ["id"]).read())
    out["ledger"] = rows(p.ledger().read().drop("h"))
    for name, schema in (("dlq", DLQ), ("stats", STATS), ("positions", "catalog_id long, pos long"), ("offsets", "topic string, part int, pos long"), ("held", "catalog_id long, pos long")):
        out[name] = rows(p.table(name, schema))
    return out


def parts(pos=0):
    first = [(1, message("a", "c", 1, 1, x=1)), (2, None), (3, "junk"), (4, message("b", "c", 5, 4, x=2)), (5, message("a", "c", None, 5, x=1)), (6, message("z", "c", 1, 6))]
    second = [(7, message("a", "u", 1, 7, x=2**40, note="n")), (8, message("a", "c", 1, 1, x=1)), (9, message("b", "d", 5, 9)), (10, message("b", "c", 6, 10, x=3))]
    return first, second


STEPS = ["mirror 1", "mirror 2", "history 1", "ledger", "dlq", "held", "holds", "positions", "stats", "offsets"]


def test_stopped_between_any_two_steps(spark, tmp_path):
    """The second batch stops after each of its steps in turn; run again, it leaves what a run without a stop leaves."""
    plain = pipeline(spark, tmp_path, history={1: ["x"]})
    for n, b in enumerate(batches(spark, tmp_path, *parts())):
        plain.run(b, n)
    want = content(plain)
    assert [json.loads(x) for x in want["mirror 1"]] == [{"id": 1, "note": "n", "x": 2**40}]
    assert [json.loads(x)["id"] for x in want["mirror 2"]] == [6]
    assert sorted(json.loads(x)["pos"] for x in want["dlq"]) == [5, 6]
    stats = {(r["catalog_id"], r["batch"]): r for r in plain.table("stats", STATS).collect()}
    assert stats[(None, 0)]["parse_skipped"] == 2 and stats[(1, 1)]["dedup_skipped"] == 1 and stats[(1, 0)]["parked"] == 1 and stats[(2, 1)]["deletes"] == 1
    p = pipeline(spark, tmp_path, history={1: ["x"]})
    b = batches(spark, tmp_path, *parts())
    p.run(b[0], 0)
    for step in STEPS:

        def stop(at, step=step):
            if at == step:
                raise OSError("stopped")

        p.after_step = stop
        with pytest.raises(OSError):
            p.run(b[1], 1)
    p.after_step = lambda _: None
    p.run(b[1], 1)
    p.run(b[1], 1)
    assert content(p) == want


def test_hold_release_and_replay(spark, tmp_path):
    """A table that fails is held whole, offsets stay below it, and after its release the mirror is that of a run without the failure."""
    first = [(1, message("a", "c", 1, 1, x=1)), (2, message("b", "c", 1, 2, x=-1)), (3, message("b", "c", 2, 3, x=5))]
    second = [(4, message("b", "u", 2, 4, x=6)), (5, message("a", "u", 1, 5, x=2)), (6, message("b", "d", 1, 6))]
    third = [(7, message("b", "c", 3, 7, x=7)), (8, message("a", "c", 2, 8, x=1))]
    rule = {"positive": (F.coalesce(F.try_variant_get("v", "$.x", "long") >= 0, F.lit(True)), "23514")}
    p = pipeline(spark, tmp_path, rules=rule, limit=0)
    b = batches(spark, tmp_path, first, second, third)
    p.run(b[0], 0)
    p.run(b[1], 1)
    offsets = lambda: {r["batch"]: r["pos"] for r in p.table("offsets", "topic string, part int, pos long").collect()}
    assert [r["catalog_id"] for r in p.held_tables(2).collect()] == [2]
    assert sorted(r["pos"] for r in p.waiting(2).collect()) == [2, 3, 4, 6] and offsets() == {0: 1, 1: 1}
    assert p.mirror(2, ["id"]).version() == -1 and [tuple(r) for r in p.mirror(1, ["id"]).read().select("id", "x").collect()] == [(1, 2)]
    # released while the cause is still there: held again, with all that waited
    p.release([2])
    p.run(b[2], 2)
    assert sorted(r["pos"] for r in p.waiting(3).collect()) == [2, 3, 4, 6, 7] and offsets()[2] == 1
    p.rules = {}
    p.release([2])
    p.run(spark.createDataFrame([("b", 0, 9, message("b", "u", 3, 9, x=8))], MESSAGE), 3)
    assert p.waiting(4).count() == 0 and p.held_tables(4).count() == 0 and offsets()[3] == 9
    q = pipeline(spark, tmp_path)
    for n, part in enumerate(b):
        q.run(part, n)
    q.run(spark.createDataFrame([("b", 0, 9, message("b", "u", 3, 9, x=8))], MESSAGE), 3)
    for i in (1, 2):
        assert sorted(map(tuple, p.mirror(i, ["id"]).read().collect())) == sorted(map(tuple, q.mirror(i, ["id"]).read().collect()))


def test_ledger_reads_only_what_may_hold(spark, tmp_path):
    """New changes ask for hardly any cut, known ones for their own; eight segments are merged, and old ones dropped."""
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    rows = lambda lo, n: spark.range(lo, lo + n).select(F.lit("t").alias("topic"), F.lit(0).alias("part"), F.col("id").alias("pos"), F.lit(1).cast("long").alias("catalog_id"), F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") * 3).alias("x"))
    for n in range(10):
        ledger.add(rows(1000 * n, 1000), n)
    assert sorted(ledger.segments()) == ["s0-7", "s8-8", "s9-9"]
    assert ledger.read().count() == 10_000
    cuts = sum(1 for _ in ledger.read().select(F.input_file_name()).distinct().collect())
    assert len(ledger.may_hold(rows(50_000, 20), 10)) <= cuts // 8
    known = ledger.may_hold(rows(8500, 1), 10)
    assert any("/s8-8/" in x for x in known) and len(known) <= 2
    mixed = rows(8990, 20).unionByName(rows(60_000, 5))
    assert sorted(r["pos"] for r in ledger.unseen(mixed, 10).collect()) == list(range(60_000, 60_005))
    assert ledger.unseen(mixed, 8).count() == 25  # an earlier batch that runs again knows nothing of later ones
    ledger.add(rows(9000, 1000), 9)
    assert ledger.read().count() == 10_000
    assert ledger.prune(8) == 1 and ledger.read().count() == 2000


def test_columns_of_a_merged_schema():
    text = "OBJECT<a: BIGINT, `b c`: STRING, d: OBJECT<x: BIGINT, y: ARRAY<STRING>>, e: DECIMAL(5,2), f: VOID, g: BOOLEAN, h: ARRAY<BIGINT>>"
    assert columns_of(text) == {"a": "bigint", "b c": "string", "d": "string", "e": "double", "g": "boolean", "h": "string"}
    assert columns_of("OBJECT<>") == {}
