"""Conflict rules on small logs, and the two Spark modes against a plain fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.operators import merge, mutate, state
from lattica.operators.merge import WRITE


def log(spark, rows):
    return spark.createDataFrame([(s, f, mutate.tagged(v), None if t is None else float(t), None if c is None else float(c), q) for q, (s, f, v, t, c) in enumerate(rows)], WRITE)


def text(v):
    return None if v["kind"] == "null" else v["num"] if v["kind"] == "number" else v["bool"] if v["kind"] == "boolean" else v["str"]


def got(df):
    return {(r["soul"], r["field"]): text(r["value"].asDict()) for r in df.collect()}


def test_modes(spark):
    rows = log(spark, [("n", "f", "A", 0, 1), ("n", "f", "B", 100, 1), ("n", "f", "C", 50, 1)])
    assert got(merge.merge_state(rows, "lww")) == got(merge.merge_state(rows, "lww_guarded")) == {("n", "f"): "B"}
    assert got(merge.merge_state(rows, "fww")) == {("n", "f"): "A"}


def test_custom_resolver_and_unknown_mode(spark):
    rows = log(spark, [("n", "f", 3, 0, 1), ("n", "f", 9, 100, 1), ("n", "f", 5, 50, 1)])
    larger = lambda ts, v, cts, cv, lam, clam: cv is None or v["num"] > cv["num"]
    assert got(merge.merge_state(rows, larger)) == {("n", "f"): 9.0}
    with pytest.raises(ValueError):
        merge.merge_state(rows, "nope")


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_clock_dominance_and_ref_tie(spark, order):
    writes = [("n", "x", 1, 100, 5), ("n", "x", 2, 100, 7)]
    refs = [("m", "r", {"#": "peerAAAA"}, 100, 1), ("m", "r", {"#": "peerBBBB"}, 100, 1)]
    rows = log(spark, [writes[i] for i in order] + [refs[i] for i in order])
    want = {("n", "x"): 2.0, ("m", "r"): "peerBBBB"}
    assert got(merge.lww(rows)) == want == got(merge.folded(rows))
    assert merge.replay_clock(merge.folded(rows)).first()["clock"] == 7


def test_ties_by_number_and_arrival(spark):
    rows = log(spark, [("a", "f", 9, 1, 1), ("a", "f", 10, 1, 1), ("b", "f", 1, 1, 1), ("b", "f", "1", 1, 1)])
    assert got(merge.folded(rows)) == {("a", "f"): 10.0, ("b", "f"): 1.0}


def test_clamp_depends_on_order(spark):
    a, b, c = ("n", "f", "a", 1, 1), ("n", "f", "b", 1, 5000), ("n", "f", "c", 1, 3000)
    first = merge.folded(log(spark, [a, b, c])).first()
    assert (first["value"]["str"], first["lamport"]) == ("c", 2001)
    second = merge.folded(log(spark, [b, a, c])).first()
    assert (second["value"]["str"], second["lamport"]) == ("b", 5000)


def test_guards(spark):
    rows = log(spark, [("n", "f", 1, 0, 1), ("n", "f", 2, 300_001, 9), ("n", "g", 1, math.nan, 1), ("n", "h", 1, 5, math.inf), ("n", "i", 1, 3e14, 1), ("n", "j", 1, None, 1)])
    assert got(merge.folded(rows)) == {("n", "f"): 1.0}


def test_shuffled_rows_agree_with_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(6)}", rng.choice("ab"), rng.choice([1, 2, "x", None, True]), rng.randrange(4), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    writes = log(spark, rows)
    want, lamports = {}, {}
    for s, f, v, t, c in rows:
        want[s, f] = merge.step(want.get((s, f)), (float(t), mutate.tagged(v), None if c is None else float(c)))
    out = {(r["soul"], r["field"]): (r["ts"], text(r["value"].asDict()), r["lamport"]) for r in merge.folded(writes.orderBy(F.rand(1)).repartition(5)).collect()}
    assert out == {k: (w[0], text(w[1]), w[2]) for k, w in want.items()}


def test_tombstones_purge_and_transactions(spark):
    rows = log(spark, [("p", "title", None, 1, 2), ("p", "body", None, 1, 2), ("q", "title", "x", 1, 1), ("q", "_txnComplete", True, 1, 1), ("r", "partial", "oops", 1, 1)])
    s = merge.lww(rows)
    assert {r["soul"] for r in state.purged(s).collect()} == {"q", "r"}
    assert got(state.committed(s)) == {("q", "title"): "x"}
    gone = mutate.delete(s, spark.createDataFrame([("p",), ("q",), ("none",)], "soul string"), 9, 4)
    assert {(r["soul"], r["field"]) for r in gone.collect()} == {("q", "title"), ("q", "_txnComplete")}
    assert state.expanded(state.compacted(s)).exceptAll(s.select("soul", "field", "value", "ts", "lamport")).count() == 0


def test_empty_log(spark):
    none = log(spark, [("a", "b", 1, 1, 1)]).limit(0)
    assert merge.lww(none).count() == merge.folded(none).count() == merge.fww(none).count() == 0


def test_number_text(spark):
    numbers = [1.0, -0.0, 0.1, 1e21, 1.5e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 1.25e-7, 5e-324, -42.5, 100.0, 0.00001234, 1.7976931348623157e308, 2.0**53]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", V.js_number_to_string(F.col("x")).alias("t")).collect()
    want = ["1", "0", "0.1", "1e+21", "1.5e+21", "100000000000000000000", "123456789012345680000", "0.000001", "1e-7", "1.25e-7", "5e-324", "-42.5", "100", "0.00001234", "1.7976931348623157e+308", "9007199254740992"]
    assert [V.js_number(x) for x in numbers] == want
    assert {r["x"]: r["t"] for r in rows if r["x"] != 5e-324} == {x: w for x, w in zip(numbers, want, strict=True) if x != 5e-324}
