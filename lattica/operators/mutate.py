"""Local writes: rows for the log, stamped with one time and clock a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.crypto import batch_nonce
from .index import point
from .merge import WRITE
from .state import MARKER, live

KINDS = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}


def tagged(x) -> dict:
    """The value struct of a Python value; {'#': soul} is a reference."""
    import json

    out = dict.fromkeys(("kind", "num", "str", "bool", "json"))
    if isinstance(x, dict) and list(x) == ["#"] and isinstance(x["#"], str):
        return out | {"kind": "ref", "str": x["#"]}
    if isinstance(x, (dict, list)):
        return out | {"kind": "json", "json": json.dumps(x, separators=(",", ":"), ensure_ascii=False)}
    kind = KINDS[type(x)]
    slot = {"boolean": "bool", "number": "num", "string": "str"}.get(kind)
    return out | {"kind": kind} | ({slot: float(x) if kind == "number" else x} if slot else {})


def put(spark: SparkSession, soul: str, fields: dict, ts: float, clock: float, seq: int = 0) -> DataFrame:
    """The writes of one call: every field at the same ts, with the Lamport clock after `clock`."""
    if not isinstance(soul, str) or not soul:
        raise TypeError("soul must be a non-empty string")
    rows = [(soul, k, tagged(v), float(ts), float(clock + 1), seq) for k, v in fields.items()]
    return spark.createDataFrame(rows, WRITE)


def next_ts(now: float, previous: float | None) -> float:
    """A time that never repeats: a thousandth of a ms after the previous one if the clock stands."""
    return now if previous is None or now > previous else previous + 0.001


def insert(rows: DataFrame, soul: Column | None = None) -> DataFrame:
    """rows with a new soul each: random, or as given for repeatable runs."""
    return rows.withColumn("soul", F.expr("uuid()") if soul is None else soul)


def update(spark: SparkSession, state: DataFrame, soul: str, fields: dict, ts: float, clock: float) -> tuple[DataFrame, DataFrame]:
    """(the writes, the node's state before them)."""
    return put(spark, soul, fields, ts, clock), point(state, soul)


def delete(state: DataFrame, souls: DataFrame, ts: float, clock: float) -> DataFrame:
    """Null writes for every field of the souls; none for those that are absent or deleted already."""
    there = live(state).where("live").join(souls.select("soul").distinct(), "soul", "left_semi")
    fields = state.join(there.select("soul"), "soul", "left_semi").select("soul", "field")
    return fields.select("soul", "field", V.null().alias("value"), F.lit(float(ts)).alias("ts"), F.lit(float(clock + 1)).alias("lamport"), F.lit(0).cast("long").alias("seq"))


def link(spark: SparkSession, soul: str, field: str, target: str, ts: float, clock: float) -> DataFrame:
    if not isinstance(target, str) or not target:
        raise TypeError("target must be a non-empty string")
    return put(spark, soul, {field: {"#": target}}, ts, clock)


def put_transaction(spark: SparkSession, soul: str, fields: dict, ts: float, clock: float) -> DataFrame:
    return put(spark, soul, {**fields, MARKER: True}, ts, clock)


def batch_writes(calls: DataFrame) -> DataFrame:
    """calls (soul, fields as JSON) with nonce: equal fields have equal nonces."""
    return calls.withColumn("nonce", batch_nonce(F.col("fields")))


def quorum(connected: int, configured: int, fraction: float) -> bool:
    """Whether enough of the configured peers are connected to write."""
    return configured == 0 or connected / configured >= fraction
