"""The driver tables as logs, nodes and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.nested import Graph

WIDTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def soul(kind: str, key: Column) -> Column:
    """kind and the zero-padded key, so that souls order as their keys do."""
    return F.concat(F.lit(f"{kind}:"), F.lpad(key.cast("string"), WIDTH, "0"))


def millis(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1000.0


def event_writes(spark: SparkSession, sf_dir: str, ts: Column | None = None, lamport: Column | None = None, events: DataFrame | None = None) -> DataFrame:
    """events as a write log: soul user, field event_type, clock and order event_id."""
    e = table(spark, sf_dir, "events") if events is None else events
    clock = F.col("event_id").cast("double") if lamport is None else lamport
    return e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("soul"), F.col("event_type").alias("field"), V.number(F.col("value")).alias("value"),
        (millis(F.col("ts")) if ts is None else ts).alias("ts"), clock.alias("lamport"), F.col("event_id").alias("seq"),
    )


#: Fixed for the test ledger: what each kind of event is worth.
DELTAS = {"view": 1.0, "error": -1.0, "click": -5.0, "signup": -3.0, "purchase": 10.0}


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    delta = F.element_at(F.create_map(*(x for k, v in DELTAS.items() for x in (F.lit(k), F.lit(v)))), F.col("event_type"))
    return e.select(F.col("user_id").alias("peer_id"), delta.alias("delta"), F.col("event_type").alias("reason"), millis(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"))


def customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(soul("customer", F.col("c_custkey")).alias("soul"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), soul("nation", F.col("c_nationkey")).alias("nation"))


def nations(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(soul("nation", F.col("n_nationkey")).alias("soul"), F.col("n_name").alias("name"), soul("region", F.col("n_regionkey")).alias("region"))


def regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").select(soul("region", F.col("r_regionkey")).alias("soul"), F.col("r_name").alias("name"))


def orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(soul("order", F.col("o_orderkey")).alias("soul"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), soul("customer", F.col("o_custkey")).alias("customer"))


def item_soul() -> Column:
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] + [F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")]
    return F.concat(F.lit("item:"), F.concat_ws("-", *parts))


def items(spark, sf_dir) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(item_soul().alias("soul"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), soul("order", F.col("l_orderkey")).alias("order"))


def with_list(parents: DataFrame, children: DataFrame, via: str, name: str) -> DataFrame:
    """parents with a list of the souls of the children that refer to them, in order."""
    lists = children.groupBy(F.col(via).alias("soul")).agg(F.array_sort(F.collect_list("soul")).alias(name))
    return parents.join(lists, "soul", "left")


def shop(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers with their orders, orders with their items, and nations with their regions."""
    nodes = {"customer": customers(spark, sf_dir), "order": orders(spark, sf_dir), "item": items(spark, sf_dir), "nation": nations(spark, sf_dir), "region": regions(spark, sf_dir)}
    refs = {("customer", "nation"): "nation", ("order", "customer"): "customer", ("item", "order"): "order", ("nation", "region"): "region"}
    return Graph(nodes, refs, {("customer", "orders"): ("order", "customer"), ("order", "items"): ("item", "order")})
