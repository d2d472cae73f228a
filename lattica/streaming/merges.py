"""Incremental forms on Structured Streaming: merge with change feed, id dedup, clock gate, retry queue.

State is keyed, kept by Spark's state store and checkpointed with the stream. Merged state
has no time-out: late writes are always let in and decided by the merge rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import LAMPORT_JUMP, TS_JUMP, newer, step
from ..operators.reputation import DROP
from ..sources.log import lines_of

FEED = "soul string, field string, value struct<kind:string,num:double,str:string,bool:boolean,json:string>, ts double, lamport double, seq long"
FLAT = "soul string, field string, kind string, num double, str string, bool boolean, json string, ts double, lamport double, seq long"
KEPT = "soul array<string>, field array<string>, kind array<string>, num array<double>, str array<string>, bool array<boolean>, json array<string>, ts array<double>, lamport array<double>"
#: Fields are kept by the hash of soul and field in so many groups; a checkpoint goes on with the number that it began with.
GROUPS = 4_096
SLOTS = ("kind", "num", "str", "bool", "json")
RETRY_MS, RETRIES, QUEUE = 5_000, 5, 10_000


def _plain(x):
    return None if x is None or x is pd.NA or isinstance(x, float) and x != x else x


def merged_stream(writes: DataFrame, resolver: Callable = newer, ts_jump: float = TS_JUMP, lamport_jump: float = LAMPORT_JUMP, groups: int = GROUPS) -> DataFrame:
    """The change feed of a stream of writes: the fields accepted, with the clocks stored for them.

    Writes of one micro-batch are folded by seq. A write that loses or is skipped emits nothing.
    A call into Python costs far more than a write, so fields come in groups, not one by one: a
    group's stored fields and its writes of a micro-batch are held together.
    """
    columns = ["soul", "field", *SLOTS, "ts", "lamport", "seq"]

    def run(key, frames: Iterator[pd.DataFrame], state):
        stored = {}
        if state.exists:
            stored = {(soul, field): (ts, dict(zip(SLOTS, slots, strict=True)), lamport) for soul, field, *slots, ts, lamport in zip(*state.get, strict=True)}
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for soul, field, *slots, ts, lamport, seq in zip(*(rows[c].tolist() for c in columns), strict=True):
            value = {k: _plain(v) for k, v in zip(SLOTS, slots, strict=True)}
            now = stored.get((soul, field))
            new = step(now, (_plain(ts), value, _plain(lamport)), resolver, ts_jump, lamport_jump)
            if new is not now:
                stored[soul, field] = new
                out.append((soul, field, *(new[1][k] for k in SLOTS), new[0], new[2], seq))
        if stored:
            kept = [(*name, *(value[k] for k in SLOTS), ts, lamport) for name, (ts, value, lamport) in stored.items()]
            state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        yield pd.DataFrame(dict(zip(columns, zip(*out, strict=True) if out else [[]] * len(columns), strict=True)), columns=columns)

    flat = writes.select(F.pmod(F.xxhash64("soul", "field"), F.lit(groups)).alias("part"), "soul", "field", *(F.col(f"value.{k}").alias(k) for k in SLOTS), "ts", "lamport", "seq")
    fed = flat.groupBy("part").applyInPandasWithState(run, FLAT, KEPT, "append", "NoTimeout")
    return fed.select("soul", "field", F.struct(*SLOTS).alias("value"), "ts", "lamport", "seq")


def latest(feed: DataFrame) -> DataFrame:
    """State from a stored change feed: the last row of each field."""
    last = F.max_by(F.struct("value", "ts", "lamport"), "seq").alias("w")
    return feed.groupBy("soul", "field").agg(last).select("soul", "field", "w.value", "w.ts", "w.lamport")


def logged(feed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts the append of accepted fields to a log of JSON lines, one a soul and micro-batch, that sources.log reads.

    A batch that is tried again overwrites its own folder, so no line is written twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        lines_of(latest(batch)).write.mode("overwrite").text(f"{path}/batch={number:012d}")

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def persisted(feed: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts the append of accepted fields to a log of Parquet files, exactly once."""
    return feed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def subscribed(state: DataFrame, feed: DataFrame, handler: Callable[[DataFrame, list[str]], None], checkpoint: str, soul: str | None = None):
    """Calls handler with the current value and no changes, then with the rows of every micro-batch and their fields."""
    mine = (lambda d: d.where(F.col("soul") == soul)) if soul is not None else (lambda d: d)
    handler(mine(state), [])

    def each(batch: DataFrame, _: int) -> None:
        rows = mine(batch)
        fields = sorted(r["field"] for r in rows.select("field").distinct().collect())  # names, of which nodes have few
        if fields:
            handler(rows, fields)

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_id(messages: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first message of each id while its time is inside the watermark."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def clock_gate(messages: DataFrame) -> DataFrame:
    """messages (conn, id, clock, seq) with in_order, judged against every earlier clock of the connection."""

    def run(key, frames, state):
        high = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for ident, clock, seq in zip(rows["id"], rows["clock"], rows["seq"], strict=True):
            clock = _plain(clock)
            ok = clock is None or clock > high
            high = max(high, clock) if clock is not None and ok else high
            out.append((key[0], ident, clock, seq, ok))
        state.update((high,))
        yield pd.DataFrame(out, columns=["conn", "id", "clock", "seq", "in_order"])

    kind = messages.schema["conn"].dataType.simpleString()
    return messages.groupBy("conn").applyInPandasWithState(run, f"conn {kind}, id string, clock double, seq long, in_order boolean", "high double", "append", "NoTimeout")


def retried(messages: DataFrame, retry_ms: int = RETRY_MS, retries: int = RETRIES, most: int = QUEUE) -> DataFrame:
    """sender, id, outcome: accept, drop or expired, for messages (sender, id, seq, score).

    Messages of a sender in the queue band wait. While any do, they are tried every retry_ms,
    whatever else arrives, under the sender's latest score: `retries` times they may be put
    back, the time after that they expire. A sender's full queue drops its oldest.
    """

    def band(score: float) -> str:
        return "accept" if score >= 0 else "drop" if score < DROP else "queue"

    def run(key, frames, state):
        ids, tries, score, due = ([], [], 0.0, 0) if not state.exists else (list(state.get[0]), list(state.get[1]), state.get[2], state.get[3])
        out, now_ms = [], state.getCurrentProcessingTimeMs()
        if ids and now_ms >= due:
            now = band(score)
            if now == "queue":
                out = [(key[0], i, "expired") for i, t in zip(ids, tries, strict=True) if t >= retries]
                left = [(i, t + 1) for i, t in zip(ids, tries, strict=True) if t < retries]
            else:
                out, left = [(key[0], i, now) for i in ids], []
            ids, tries, due = [i for i, _ in left], [t for _, t in left], now_ms + retry_ms
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for ident, score in zip(rows["id"], rows["score"], strict=True):
                now = band(score)
                if now == "queue":
                    due = due if ids else now_ms + retry_ms
                    ids.append(ident)
                    tries.append(0)
                else:
                    out.append((key[0], ident, now))
            while len(ids) > most:
                out.append((key[0], ids.pop(0), "drop"))
                tries.pop(0)
        state.update((ids, tries, float(score), int(due)))
        if ids:
            state.setTimeoutDuration(max(1, due - now_ms))
        yield pd.DataFrame(out, columns=["sender", "id", "outcome"])

    return messages.groupBy("sender").applyInPandasWithState(run, "sender string, id string, outcome string", "ids array<string>, tries array<int>, score double, due long", "append", "ProcessingTimeTimeout")

