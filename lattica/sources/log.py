"""The write log as newline-delimited JSON: {"soul", "fields", "ts", "lamportClock"}, one entry a line.

ts and lamportClock are one number for all fields of an entry, or an object with one by field.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import from_variant
from ..operators.merge import merge_state

SPLIT = ("file_modification_time", "file_path", "file_block_start")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, entry (VARIANT) of every line that is JSON; blank and torn lines are dropped, wherever they are.

    seq orders lines as the log was written: files by modification time and path, splits of a
    file by their start, lines by their place in the split.
    """
    lines = spark.read.text(path).select("value", *(F.col(f"_metadata.{c}").alias(c) for c in SPLIT))
    splits = lines.select(*SPLIT).distinct()  # one row a split, so few
    ranked = splits.withColumn("split__", F.row_number().over(Window.orderBy(*SPLIT)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task, whose rows are in file order
    rows = lines.withColumn("place__", place).join(ranked, list(SPLIT)).where("trim(value) <> ''")
    seq = F.shiftleft(F.col("split__").cast("long"), 33).bitwiseOR(F.col("place__"))
    return rows.select(seq.alias("seq"), F.try_parse_json("value").alias("entry")).where("entry is not null")


def writes(entries: DataFrame) -> DataFrame:
    """soul, field, value, ts, lamport, seq of entries whose soul is a non-empty string."""
    soul = F.try_variant_get("entry", "$.soul", "string")
    is_text = F.schema_of_variant(F.variant_get("entry", "$.soul", "variant")) == "STRING"
    rows = entries.where(is_text & (F.length(soul) > 0)).select(
        "seq", soul.alias("soul"), F.variant_get("entry", "$.fields", "variant").alias("fields"), F.variant_get("entry", "$.ts", "variant").alias("ts"), F.variant_get("entry", "$.lamportClock", "variant").alias("lamport")
    )
    rows.createOrReplaceTempView(view := f"entries_{uuid.uuid4().hex}")
    each = rows.sparkSession.sql(f"select e.seq, e.soul, v.key as field, v.value as raw, e.ts, e.lamport from {view} e, lateral variant_explode(e.fields) v where v.key is not null")

    def clock(c):
        by_field = F.element_at(F.try_variant_get(c, "$", "map<string,double>"), F.col("field"))
        return F.coalesce(F.try_variant_get(c, "$", "double"), by_field)

    return each.select("soul", "field", from_variant(F.col("raw")).alias("value"), clock("ts").alias("ts"), clock("lamport").alias("lamport"), F.col("seq").cast("long").alias("seq"))


def load(spark: SparkSession, path: str, mode: str = "lww_guarded", **guards) -> DataFrame:
    """State of a log, entries merged in their order with their own clocks."""
    return merge_state(writes(read_lines(spark, path)), mode, **guards)


def _json_value(v):
    plain = F.when(v["kind"] == "null", "null").when(v["kind"] == "json", v["json"]).when(v["kind"] == "boolean", v["bool"].cast("string"))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return plain.when(v["kind"] == "number", text(v["num"])).when(v["kind"] == "ref", F.concat(F.lit('{"#":'), text(v["str"]), F.lit("}"))).otherwise(text(v["str"]))


def lines_of(state: DataFrame) -> DataFrame:
    """value: one JSON line a soul, with the clocks of every field."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("field").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    parts = {
        "fields": F.concat(quoted, F.lit(":"), _json_value(F.col("value"))),
        "ts": F.concat(quoted, F.lit(":"), F.to_json(F.struct(F.col("ts").alias("x"))).substr(F.lit(6), F.lit(40))),
        "lamport": F.when(F.col("lamport").isNotNull(), F.concat(quoted, F.lit(":"), F.to_json(F.struct(F.col("lamport").alias("x"))).substr(F.lit(6), F.lit(40)))),
    }
    cut = lambda c: F.regexp_replace(c, r"\}$", "")
    rows = state.select("soul", parts["fields"].alias("f"), cut(parts["ts"]).alias("t"), cut(parts["lamport"]).alias("l"))
    all_of = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit("}"))
    grouped = rows.groupBy("soul").agg(all_of("f").alias("f"), all_of("t").alias("t"), all_of("l").alias("l"))
    soul = F.regexp_extract(F.to_json(F.struct(F.col("soul").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return grouped.select(F.concat(F.lit('{"soul":'), soul, F.lit(',"fields":'), F.col("f"), F.lit(',"ts":'), F.col("t"), F.lit(',"lamportClock":'), F.col("l"), F.lit("}")).alias("value"))


def append(state: DataFrame, path: str) -> None:
    """Adds entries to a log; Spark's commit protocol stands for the write queue and the sync."""
    lines_of(state).write.mode("append").text(path)


def rewrite(spark: SparkSession, path: str, new_path: str, transform) -> None:
    """A new log of the transformed state of an old one; the old one is never overwritten while it is read."""
    lines_of(transform(load(spark, path))).write.mode("errorifexists").text(new_path)


def save_snapshot(rows: DataFrame, path: str) -> None:
    """A small table as its one current snapshot."""
    rows.write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot, or no rows where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


LEDGER = "peer_id string, delta double, reason string, ts double, seq long"


def append_ledger(entries: DataFrame, path: str) -> None:
    """Adds reputation entries to their own log."""
    entries.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").json(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The reputation log; malformed lines and those without a peer or delta are dropped."""
    return load_snapshot(spark, path, LEDGER).where("peer_id is not null and delta is not null")
