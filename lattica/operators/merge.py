"""Conflict resolution: a log of field writes reduced to current state.

A write is soul, field, value (the tagged struct), ts (ms), lamport, seq (arrival order).
A write wins over the stored one if its Lamport clock is greater, where both have one and
they differ; else if its ts is greater; else if its value is: numbers by size, all else by
canonical text. Equal writes change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import VALUE, canonical_value, js_number
from .folds import fold

WRITE = T.StructType(
    [T.StructField("soul", T.StringType()), T.StructField("field", T.StringType()), T.StructField("value", VALUE), T.StructField("ts", T.DoubleType()), T.StructField("lamport", T.DoubleType()), T.StructField("seq", T.LongType())]
)
STATE = "soul string, field string, value struct<kind:string,num:double,str:string,bool:boolean,json:string>, ts double, lamport double"
#: How far a ts may be ahead of the stored one, the last ts a first write may have, the Lamport clamp, fields a call.
TS_JUMP, LAST_TS, LAMPORT_JUMP, MOST_FIELDS = 300_000.0, 253_402_300_799_999.0, 1000.0, 1000


def finite(writes: DataFrame) -> DataFrame:
    """Writes that no guard skips by themselves: ts is a finite number, and lamport if given."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return writes.where(ok("ts") & (F.col("lamport").isNull() | ok("lamport")))


def lww(writes: DataFrame) -> DataFrame:
    """Last write wins in one aggregation, without the guards.

    Equal to the ordered fold where every write has a Lamport clock, no guard fires and the
    values of a tie are of one kind.
    """
    text = F.when(F.col("value.kind") != "number", canonical_value(F.col("value"), numbers=False))  # numbers tie by size
    order = F.struct(F.coalesce("lamport", F.lit(-float("inf"))), F.col("ts"), F.col("value.num"), text)
    best = F.max_by(F.struct("value", "ts", "lamport"), order)
    return finite(writes).groupBy("soul", "field").agg(best.alias("w")).select("soul", "field", "w.value", "w.ts", "w.lamport")


def fww(writes: DataFrame) -> DataFrame:
    """First write wins: the first arrival that the guards let in."""
    first = F.min_by(F.struct("value", "ts", "lamport"), "seq")
    return finite(writes).where(F.col("ts") <= LAST_TS).groupBy("soul", "field").agg(first.alias("w")).select("soul", "field", "w.value", "w.ts", "w.lamport")


def _text(v: dict) -> str:
    kind = v["kind"]
    if kind == "ref":
        return "#" + v["str"]
    if kind == "number":
        return js_number(v["num"])
    return {"json": v["json"], "boolean": "true" if v["bool"] else "false", "null": "null"}.get(kind, v["str"])


def newer(ts, value, cur_ts, cur_value, lamport, cur_lamport) -> bool:
    """The default rule, as a resolver."""
    if cur_ts is None:
        return True
    if lamport is not None and cur_lamport is not None and lamport != cur_lamport:
        return lamport > cur_lamport
    if ts != cur_ts:
        return ts > cur_ts
    if value["kind"] == cur_value["kind"] == "number":
        return value["num"] > cur_value["num"]
    return _text(value) > _text(cur_value)


def step(stored, write, resolver: Callable = newer, ts_jump: float = TS_JUMP, lamport_jump: float = LAMPORT_JUMP):
    """(ts, value, lamport) after a write, the very object stored if it is skipped or loses."""
    ts, value, lamport = write
    if ts is None or not math.isfinite(ts) or lamport is not None and not math.isfinite(lamport):
        return stored
    if ts > (LAST_TS if stored is None else stored[0] + ts_jump):
        return stored
    cur = stored or (None, None, None)
    if not resolver(ts, value, cur[0], cur[1], lamport, cur[2]):
        return stored
    if lamport is not None and stored is not None and cur[2] is not None:
        lamport = min(lamport, cur[2] + lamport_jump)
    return ts, value, lamport


def folded(writes: DataFrame, resolver: Callable = newer, ts_jump: float = TS_JUMP, lamport_jump: float = LAMPORT_JUMP) -> DataFrame:
    """The guarded, order-dependent merge: writes of a field folded one after another by seq.

    Rows are dealt by (soul, field) and streamed in order, one stored write in memory at a
    time, so a field with any number of writes is never held whole.
    """

    def run(batches):
        key, stored = None, None
        kind = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("str", pa.string()), ("bool", pa.bool_()), ("json", pa.string())])
        names = ["soul", "field", "value", "ts", "lamport"]

        def out(rows):
            types = [pa.string(), pa.string(), kind, pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=names)

        for batch in batches:
            done = []
            for soul, field, value, ts, lamport in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (soul, field) != key:
                    if stored is not None:
                        done.append((*key, stored[1], stored[0], stored[2]))
                    key, stored = (soul, field), None
                stored = step(stored, (ts, value, lamport), resolver, ts_jump, lamport_jump)
            yield out(done)
        if stored is not None:
            yield out([(*key, stored[1], stored[0], stored[2])])

    rows = writes.repartition("soul", "field").sortWithinPartitions("soul", "field", "seq")
    return rows.select("soul", "field", "value", "ts", "lamport").mapInArrow(run, STATE)


def merge_state(writes: DataFrame, mode: str | Callable = "lww", **guards) -> DataFrame:
    """State under "lww" (fast, unguarded), "lww_guarded", "fww" or a resolver of
    (ts, value, current ts, current value, lamport, current lamport) -> bool."""
    if callable(mode):
        return folded(writes, mode, **guards)
    modes = {"lww": lww, "fww": fww, "lww_guarded": lambda w: folded(w, **guards)}
    if mode not in modes:
        raise ValueError(f"unknown merge mode {mode!r}")
    return modes[mode](writes)


def within_call(writes: DataFrame, call: str) -> DataFrame:
    """Writes of calls of at most MOST_FIELDS fields; call names the column that numbers the calls."""
    large = writes.groupBy(call).agg(F.count("*").alias("n")).where(F.col("n") > MOST_FIELDS).select(call)
    return writes.join(large, call, "left_anti")


def local_clock(calls: DataFrame) -> DataFrame:
    """node, clock: the local Lamport clock of each node after its calls, folded by seq from 0.

    calls: node, seq, accepted (whether any field was), lamport (the call's own clock, null for
    a local write), by_field (the greatest clock stored for an accepted field, where a call
    had clocks by field, else null). Rejected calls move nothing; no call moves the clock by
    more than LAMPORT_JUMP and one.
    """

    def step(clock, accepted, lamport, by_field):
        if not accepted:
            return clock
        if by_field is not None:
            return max(clock, min(by_field, clock + LAMPORT_JUMP))
        return max(clock, min(lamport, clock + LAMPORT_JUMP)) + 1 if lamport is not None else clock + 1

    return fold(calls, "node", "seq", ["accepted", "lamport", "by_field"], 0.0, step, float, "clock")


def replay_clock(state: DataFrame) -> DataFrame:
    """clock: the local Lamport clock after a replay, the greatest stored one, 0 for none."""
    return state.agg(F.coalesce(F.max("lamport"), F.lit(0.0)).alias("clock"))
