"""Reputation: capped running scores over a ledger, throttle bands, compaction.

A ledger has peer_id, delta, reason, ts, seq. A live score is capped at CAP at every step;
a restored one is the capped sum, so both are given where they may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cap, drop and isolation thresholds, ledger length.
CAP, DROP, ISOLATED, LEDGER = 20.0, -10.0, -20.0, 20_000


def running(ledger: DataFrame, cap: float = CAP) -> DataFrame:
    """ledger with score after each entry: the running sum less what the cap has cut so far."""
    w = Window.partitionBy("peer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = ledger.withColumn("sum__", F.sum("delta").over(w))
    over = F.greatest(F.lit(0.0), F.max("sum__").over(w) - cap)
    return summed.withColumn("score", F.col("sum__") - over).drop("sum__")


def scores(ledger: DataFrame, cap: float = CAP) -> DataFrame:
    """peer_id, score (live), restored (after a compaction), entries."""
    last = F.max_by("score", "seq").alias("score")
    return running(ledger, cap).groupBy("peer_id").agg(last, F.least(F.lit(cap), F.sum("delta")).alias("restored"), F.count("*").alias("entries"))


def throttle(score: Column) -> Column:
    return F.when(score >= 0, "accept").when(score < DROP, "drop").otherwise("queue")


def isolated(score: Column, threshold: float = ISOLATED) -> Column:
    return score < threshold


def of_peer(ledger: DataFrame, peer: str) -> DataFrame:
    return ledger.where(F.col("peer_id") == peer)


def capped_ledger(ledger: DataFrame, n: int = LEDGER) -> DataFrame:
    """The last n entries by seq over all peers.

    The n-th seq from the end is found first, so nothing is sorted in one task beyond n rows.
    """
    edge = ledger.select("seq").orderBy(F.desc("seq")).limit(n).agg(F.min("seq").alias("edge"))
    return ledger.join(F.broadcast(edge), F.col("seq") >= F.col("edge")).drop("edge")  # one row


def compacted(ledger: DataFrame) -> DataFrame:
    """One entry a peer: the sum, and the last reason and time; malformed rows are skipped."""
    fine = ledger.where("peer_id is not null and delta is not null and not isnan(delta)")
    last = F.max_by(F.struct("reason", "ts"), "seq")
    return fine.groupBy("peer_id").agg(F.sum("delta").alias("delta"), last.alias("l")).select("peer_id", "delta", "l.reason", "l.ts")


def gossip(entries: DataFrame, window_s: int = 60, targets: int = 20, each: int = 5) -> DataFrame:
    """Remote entries that count: deltas clamped to [-5, 10], repeats dropped, and by connection
    and window the first targets peers and the first each entries of a peer.

    entries: conn, peer_id, delta, reason, ts (ms), seq. Windows are aligned to the clock.
    """
    rows = entries.withColumn("delta", F.greatest(F.lit(-5.0), F.least(F.lit(10.0), F.col("delta"))))
    once = rows.groupBy("peer_id", "delta", "reason", "ts").agg(F.min_by(F.struct("conn", "seq"), "seq").alias("m"))
    rows = once.select("m.conn", "peer_id", "delta", "reason", "ts", "m.seq", F.floor(F.col("ts") / (window_s * 1000)).cast("long").alias("window"))
    own = Window.partitionBy("conn", "window", "peer_id")
    rows = rows.withColumn("first__", F.min("seq").over(own)).withColumn("k__", F.row_number().over(own.orderBy("seq")))
    rank = F.dense_rank().over(Window.partitionBy("conn", "window").orderBy("first__"))
    return rows.withColumn("t__", rank).where((F.col("t__") <= targets) & (F.col("k__") <= each)).drop("first__", "k__", "t__")
