"""Views of state: wide nodes, tombstones, transactions, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "_txnComplete"


def typed(v: Column, kind: T.DataType) -> Column:
    """A tagged value as a column of a type; null for values of other kinds."""
    if isinstance(kind, T.StringType):
        return F.when(v["kind"].isin("string", "ref"), v["str"])
    if isinstance(kind, T.BooleanType):
        return v["bool"]
    if isinstance(kind, T.NumericType):
        return v["num"].cast(kind)
    return F.from_json(v["json"], kind.simpleString())


def wide(state: DataFrame, schema: T.StructType) -> DataFrame:
    """One row a soul with the fields of schema as columns, and _fields: the names of those present."""
    fields = [f for f in schema if f.name != "soul"]
    columns = [F.first(F.when(F.col("field") == f.name, typed(F.col("value"), f.dataType)), ignorenulls=True).alias(f.name) for f in fields]
    return state.groupBy("soul").agg(*columns, F.array_sort(F.collect_set("field")).alias("_fields"))


def live(state: DataFrame) -> DataFrame:
    """soul, live: whether any field is not null."""
    return state.groupBy("soul").agg(F.bool_or(F.col("value.kind") != "null").alias("live"))


def purged(state: DataFrame) -> DataFrame:
    """State without the souls all of whose fields are null."""
    return state.join(live(state).where("live").select("soul"), "soul", "left_semi")


def committed(state: DataFrame) -> DataFrame:
    """The nodes of finished transactions: marker true, and without the marker."""
    done = state.where((F.col("field") == MARKER) & (F.col("value.kind") == "boolean") & F.col("value.bool")).select("soul")
    return state.where(F.col("field") != MARKER).join(done, "soul", "left_semi")


def compacted(state: DataFrame, purge_deleted: bool = False) -> DataFrame:
    """One log entry a soul: soul, fields (array of field, value, ts, lamport by field)."""
    state = purged(state) if purge_deleted else state
    return state.groupBy("soul").agg(F.array_sort(F.collect_list(F.struct("field", "value", "ts", "lamport"))).alias("fields"))


def expanded(entries: DataFrame) -> DataFrame:
    """State of compacted entries."""
    return entries.select("soul", F.explode("fields").alias("f")).select("soul", "f.field", "f.value", "f.ts", "f.lamport")


def counts(state: DataFrame, *by: str) -> DataFrame:
    """nodes, fields (by the given columns): what peers compare to see whether they agree."""
    return state.groupBy(*by).agg(F.count_distinct("soul").alias("nodes"), F.count("*").alias("fields"))
