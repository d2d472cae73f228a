"""Admission gates over a batch of messages, cheapest first.

messages: conn, seq, raw (JSON text), and what parsing gives: id, type, soul, sender,
signature, clock, pow, fields. In a batch the gates are judged independently of the
penalties they cause; the streaming form feeds penalties back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crypto import hex_soul, signed_text, verify, work_digest, work_done, work_hash
from .reputation import throttle

#: Penalties by reason.
PENALTIES = {"parse": -1, "envelope": -1, "signature_missing": -3, "signature": -3, "clock": -1, "clock_order": -5, "work": -3, "ledger_length": -1}
MOST_LEDGER, HELP, GOOD = 20_000, 10.0, 1.0


def parsed(messages: DataFrame) -> DataFrame:
    """messages(conn, seq, raw) with body (VARIANT, null where JSON fails) and the envelope's fields."""
    body = F.try_parse_json("raw")
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    return messages.withColumn("body", body).withColumns(
        {
            "id": F.when(F.schema_of_variant(F.variant_get("body", "$.id", "variant")) == "STRING", get("$.id", "string")),
            "type": get("$.type", "string"),
            "soul": get("$.soul", "string"),
            "sender": get("$.sender", "string"),
            "signature": get("$.signature", "string"),
            "clock": get("$.lamportClock", "double"),
            "has_clock": F.variant_get("body", "$.lamportClock", "variant").isNotNull(),
            "fields_json": F.to_json(F.variant_get("body", "$.fields", "variant")),
            "ts_json": F.to_json(F.variant_get("body", "$.ts", "variant")),
            "has_pow": F.coalesce(~F.schema_of_variant(F.variant_get("body", "$.pow", "variant")).isin("VOID"), F.lit(False)),
            "pow_nonce": get("$.pow.nonce", "double"),
            "pow_difficulty": get("$.pow.difficulty", "double"),
            "ledger": get("$.reputationLedger", "array<variant>"),
        }
    )


def envelope(body: Column, message_id: Column) -> Column:
    """Whether a message is an object with an id of 1 to 256 characters."""
    return F.coalesce(F.schema_of_variant(body).startswith("OBJECT") & F.length(message_id).between(1, 256), F.lit(False))


def first_of_id(messages: DataFrame) -> DataFrame:
    """The first arrival of each id."""
    best = F.min_by(F.struct(*(c for c in messages.columns if c != "id")), "seq").alias("m")
    return messages.groupBy("id").agg(best).select("id", "m.*").select(*messages.columns)


def needs_signature(kind: Column, soul: Column) -> Column:
    return (kind == "put") & hex_soul(soul)


def clock_order(messages: DataFrame) -> DataFrame:
    """messages with in_order: the clock is greater than every earlier one of its connection; no clock passes."""
    w = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("in_order", F.col("clock").isNull() | (F.col("clock") > F.coalesce(F.max("clock").over(w), F.lit(0))))


def work_ok(soul: Column, message_id: Column, digest: Column, nonce: Column, difficulty: int, required: bool) -> Column:
    """Proof of work: verified where given, and needed where required."""
    done = work_done(work_hash(soul, message_id, digest, nonce), difficulty)
    return F.when(nonce.isNull(), F.lit(not required)).otherwise(done)


def ledger_fits(ledger: Column) -> Column:
    return F.coalesce(F.size(ledger), F.lit(0)) <= MOST_LEDGER


def gated(messages: DataFrame, signature_ok: Column | None = None, scores: DataFrame | None = None, difficulty: int | None = None) -> DataFrame:
    """parsed messages with reject: the first gate that turns a message away, null for those let in, and its penalty.

    scores (peer_id, score): connections in the drop band are turned away before any costly
    gate, without a penalty. difficulty: puts must carry work of it; else work is verified
    where it is given.
    """
    # a message without an id is alone in its window
    seen = Window.partitionBy(F.coalesce(F.col("id"), F.concat_ws("\u0000", F.lit(""), F.col("conn").cast("string"), F.col("seq").cast("string")))).orderBy("seq")
    rows = messages.withColumn("nth", F.row_number().over(seen))
    band = F.lit("accept")
    if scores is not None:
        known = scores.select(F.col("peer_id").cast("string").alias("conn__"), F.col("score").alias("score__"))
        rows = rows.join(known, F.col("conn").cast("string") == F.col("conn__"), "left")
        band = throttle(F.coalesce("score__", F.lit(0.0)))
    unsigned = needs_signature(F.col("type"), F.col("soul")) & (F.col("sender").isNull() | F.col("signature").isNull())
    bad_clock = F.col("has_clock") & (F.col("clock").isNull() | F.isnan("clock"))
    reject = F.when(F.col("body").isNull(), "parse").when(~envelope(F.col("body"), F.col("id")), "envelope").when(F.col("nth") > 1, "repeat").when(band == "drop", "throttled").when(unsigned, "signature_missing")
    if signature_ok is not None:
        reject = reject.when(F.col("signature").isNotNull() & F.col("sender").isNotNull() & ~signature_ok, "signature")
    rows = rows.withColumn("reject", reject.when(bad_clock, "clock")).drop("nth", "conn__", "score__")
    # only messages that come this far move a connection's clock
    w = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(F.col("reject").isNull(), F.col("clock"))).over(w), F.lit(0))
    rows = rows.withColumn("reject", F.coalesce("reject", F.when(F.col("clock") <= before, "clock_order")))
    late = F.when(~message_work_ok(difficulty), "work").when(F.size("ledger") > MOST_LEDGER, "ledger_length")
    rows = rows.withColumn("reject", F.coalesce("reject", late))
    penalty = F.create_map(*(x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))))
    return rows.withColumn("penalty", F.coalesce(F.element_at(penalty, F.col("reject")), F.lit(0)))


def message_work_ok(difficulty: int | None) -> Column:
    """Whether a parsed message's work holds: soul, id, fields and ts under the nonce, of the difficulty it states, which is `difficulty` at least."""
    digest = work_digest(F.coalesce("fields_json", F.lit("{}")), F.coalesce("ts_json", F.lit("{}")))
    nonce = F.when(F.col("pow_nonce") == F.floor("pow_nonce"), F.col("pow_nonce").cast("long").cast("string")).otherwise(F.col("pow_nonce").cast("string"))
    done = F.coalesce(work_done(work_hash(F.coalesce("soul", F.lit("undefined")), F.col("id"), digest, nonce), F.col("pow_difficulty")) & F.col("pow_nonce").isNotNull(), F.lit(False))
    if difficulty is None:
        return ~F.col("has_pow") | done
    return (F.coalesce(F.col("type"), F.lit("")) != "put") | (done & (F.col("pow_difficulty") >= difficulty))


def admitted(messages: DataFrame, scores: DataFrame, verify_signatures: bool = True, difficulty: int | None = None) -> DataFrame:
    """conn, seq, id, soul, outcome, peer, delta: the whole chain, from raw messages (conn, seq, raw) to accept, queue or the gate that turned one away.

    peer and delta are the entry that the message adds to the ledger: a penalty for its
    connection, or the reward of a put that is accepted for its sender if the signature
    holds, else for its connection. Scores are those from before the batch.
    """
    rows = parsed(messages)
    signed = verify(F.col("sender"), signed_text(F.col("raw")), F.col("signature")) if verify_signatures else F.lit(True)
    rows = gated(rows, signed, scores, difficulty)
    verified = F.col("sender").isNotNull() & F.col("signature").isNotNull()  # those whose signature fails are out by now
    rows = throttled(rows, scores, verified)
    outcome = F.coalesce("reject", F.when(F.col("band") == "drop", "throttled").when(F.col("band") == "queue", "queue").otherwise("accept"))
    rows = rows.withColumn("outcome", outcome)
    rewarded = (F.col("outcome") == "accept") & (F.col("type") == "put")
    peer = F.when(rewarded & verified, F.col("sender")).when(rewarded | (F.col("penalty") != 0), F.col("conn").cast("string"))
    delta = F.when(rewarded, F.lit(GOOD)).when(F.col("penalty") != 0, F.col("penalty").cast("double"))
    return rows.select("conn", "seq", "id", "soul", "outcome", peer.alias("peer"), delta.alias("delta"))


def throttled(messages: DataFrame, scores: DataFrame, verified: Column) -> DataFrame:
    """messages with band (accept, queue, drop): the score of the sender if verified, else of the connection, unknown ones 0."""
    key = F.when(verified, F.col("sender")).otherwise(F.col("conn").cast("string"))
    known = scores.select(F.col("peer_id").cast("string").alias("key__"), "score")
    rows = messages.withColumn("key__", key).join(known, "key__", "left")
    return rows.withColumn("band", throttle(F.coalesce("score", F.lit(0.0)))).drop("key__", "score")


def routing_help(messages: DataFrame, sent: DataFrame, targets: DataFrame) -> DataFrame:
    """conn, id, delta: connections that brought a message of this node back by another way than those it was sent to.

    messages: conn, seq, id, digest; sent: id, digest of the messages this node sent; targets:
    id, conn, where each was sent. The first such arrival with the digest that was sent earns
    HELP, once an id. Messages that this node never sent earn nothing.
    """
    own = sent.select("id", F.col("digest").alias("sent__")).distinct()
    back = messages.join(own, "id").where(F.col("digest") == F.col("sent__"))
    other = back.join(targets.select("id", "conn").distinct(), ["id", "conn"], "left_anti")
    return other.groupBy("id").agg(F.min_by("conn", "seq").alias("conn")).select("conn", "id", F.lit(HELP).alias("delta"))
