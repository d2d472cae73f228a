"""Access by key: point, prefix and range look-ups over souls, and files sorted for them.

An entry table has soul, timestamp, entry and source (a later source wins a tie).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point(nodes: DataFrame, soul: str) -> DataFrame:
    return nodes.where(F.col("soul") == soul)


def field_times(state: DataFrame, soul: str) -> DataFrame:
    return point(state, soul).select("field", "ts")


def prefix(nodes: DataFrame, start: str) -> DataFrame:
    """Distinct souls that begin with start, in order; the test reaches the files."""
    return nodes.where(F.col("soul").startswith(start)).select("soul").distinct().orderBy("soul")


def souls_between(nodes: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct souls in [start, end), in order."""
    return nodes.where((F.col("soul") >= start) & (F.col("soul") < end)).select("soul").distinct().orderBy("soul")


def newest(entries: DataFrame) -> DataFrame:
    """The newest entry of each soul, later sources first among equals."""
    best = F.max_by(F.struct("timestamp", "entry", "source"), F.struct("timestamp", "source"))
    return entries.groupBy("soul").agg(best.alias("b")).select("soul", "b.timestamp", "b.entry", "b.source")


def newest_by_prefix(entries: DataFrame, start: str) -> DataFrame:
    """Newest entries of souls with a prefix, newest first, then by falling soul."""
    return newest(entries.where(F.col("soul").startswith(start))).orderBy(F.desc("timestamp"), F.desc("soul"))


def rebuilt(state: DataFrame) -> DataFrame:
    """soul, timestamp: a node's entry is as new as its newest field."""
    return state.groupBy("soul").agg(F.max("ts").alias("timestamp"))


def write_sorted(entries: DataFrame, path: str) -> None:
    """Files sorted by soul, whose row-group bounds serve look-ups."""
    entries.repartitionByRange("soul").sortWithinPartitions("soul").write.mode("errorifexists").parquet(path)


def merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two tables as one: the newer entry of each soul, the second table's where equal."""
    return newest(older.withColumn("source", F.lit(0)).unionByName(newer.withColumn("source", F.lit(1)))).drop("source")


def upserted(entries: DataFrame, added: DataFrame) -> DataFrame:
    """entries with added ones; an entry that is there already changes nothing."""
    return merged(entries, added)


def statistics(entries: DataFrame) -> DataFrame:
    """By file: entries, least and greatest soul."""
    by = F.input_file_name().alias("file")
    return entries.groupBy(by).agg(F.count("*").alias("entries"), F.min("soul").alias("min_soul"), F.max("soul").alias("max_soul"))


def latest_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
