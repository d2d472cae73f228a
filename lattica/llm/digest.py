"""Canonical exact digests: documents that differ only in form, case or white space are equal.

A text's canonical form is NFKC, case folded, NFKC again, its white space runs one space and
its ends trimmed. Its digest is XXH3-128 of the canonical UTF-8 bytes. Documents are grouped
by digest and the canonical bytes compared inside each group of more than one; where bytes
differ, which no known input shows, each distinct form gets a digest of its own by rank.
For that comparison only the texts of digests that occur twice are shuffled: a bitmap of
those digests, of bounded size, is applied on the scan.

Null and empty texts have the canonical form "" and share one digest. Null ids sort first,
rows of one id by a hash of their text, and any number of them may share an id.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_KEY, KeyFilter, Ranges, key_ranges, keyed, lean, materialize, sliced, table

ROWS_A_RANGE = 1024


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def form_key(form: bytes) -> str:
    """A second name of a form, independent of its digest."""
    return hashlib.sha256(form).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, form of every row of docs(doc_id, text)."""

    @lean
    def run(batches):
        for batch in sliced(batches):
            forms = [canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(map(digest, forms), pa.string()), pa.array(map(form_key, forms), pa.string())], names=["doc_id", "digest", "form"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, digest string, form string")


def _longs(digests: list[str]) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests], np.uint64).view(np.int64)


def collisions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """digest: those whose documents differ in canonical bytes.

    Of each digest the least and the greatest form are compared, aggregated before the
    shuffle, so a group of any size sends one pair a task. Forms travel compressed; equal
    bytes compress to equal bytes.
    """
    twice = materialize(found.groupBy("digest").count().where("count > 1").select("digest"), "twice")
    if twice.isEmpty():
        return twice
    wanted = KeyFilter.of(twice.select(F.conv(F.substring("digest", 1, 16), 16, -10).cast("long").alias("key")), "key")

    @lean
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            forms = [canonical(t) for t in batch.column(0).to_pylist()]
            names = [digest(f) for f in forms]
            there = np.flatnonzero(wanted.may_have(_longs(names))).tolist()
            yield pa.record_batch([pa.array([names[i] for i in there], pa.string()), pa.array([pack.compress(forms[i]) for i in there], pa.binary())], names=["digest", "z"])

    forms = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "digest string, z binary")
    return forms.groupBy("digest").agg(F.min("z").alias("low"), F.max("z").alias("high")).where("low <> high").select("digest")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (the least doc_id of equal canonical texts), copies."""
    found = materialize(digests(docs), "digest")
    named = confirmed(docs, found)
    groups = named.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    return named.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")


def confirmed(docs: DataFrame, found: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    """found(digest, form) with fingerprint: the digest, or digest-rank where the bytes of a digest differ.

    others: columns of further digests and of their forms, which are named alike.
    """
    pairs = {"digest": "form"} | (others or {})
    names = {d: "fingerprint" if d == "digest" else d.replace("digest", "fingerprint") for d in pairs}
    odd = materialize(collisions(docs, found), "collisions")
    if odd.isEmpty():
        return found.withColumns({names[d]: F.col(d) for d in pairs})
    every = [found.select(F.col(d).alias("digest"), F.col(f).alias("form")) for d, f in pairs.items()]
    forms = every[0]
    for more in every[1:]:
        forms = forms.union(more)
    ranks = forms.join(odd, "digest", "left_semi").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("form")))
    for d, f in pairs.items():
        own = ranks.select(F.col("digest").alias(d), F.col("form").alias(f), F.col("rank"))
        found = found.join(own, [d, f], "left").withColumn(names[d], F.when(F.col("rank") > 1, F.concat_ws("-", d, F.col("rank"))).otherwise(F.col(d))).drop("rank")
    return found


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, digest string, form string, edited_digest string, edited_form string, near_edited double, near_next double"


@lean
def _compared(batches):
    """Rows of whole ranges in order, each range ended by copies of the next range's first row."""
    held, opened = None, zstandard.ZstdDecompressor()
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
    names = [c.split()[0] for c in OUT.split(", ")]

    def row(now, following):
        _, doc, text, form, _ = now
        new = edited(text, following[2])
        new_form = canonical(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), sha, digest(form), form_key(form), digest(new_form), form_key(new_form), float(form == new_form), float(form == following[3]))

    for batch in sliced(batches):
        out = []
        for part, doc, z, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = opened.decompress(z).decode("utf-8", "surrogatepass") if z else ""
            now = (part, doc, text, canonical(text), tail)
            if held is not None and held[0] == part and not held[4]:
                out.append(row(held, now))
            held = now
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)], names=names)


def _firsts(rows: DataFrame, ranges: Ranges) -> dict[int, tuple[int, int]]:
    """The least (key, h) of each range that has rows: at most as many as there are ranges."""

    def run(batches):
        for batch in batches:
            keys, hs = (np.asarray(batch.column(i)) for i in (0, 1))
            order = np.lexsort((hs, keys))
            parts = ranges.of(keys, hs)[order]
            at = order[np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])] if len(order) else order
            yield pa.record_batch([pa.array(ranges.of(keys[at], hs[at])), pa.array(keys[at]), pa.array(hs[at])], names=["part", "key", "h"])

    found = rows.mapInArrow(run, "part long, key long, h long").groupBy("part").agg(F.min(F.struct("key", "h")).alias("f"))
    return {r["part"]: (r["f"]["key"], r["f"]["h"]) for r in found.collect()}


def compare_edited(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Each document's digest beside that of its edited text and the next document's, by doc_id.

    Documents are dealt by ranges of doc_id; each range also gets the first row of the next
    range that has any (the last: the first of all), so neighbours meet with one shuffle and
    no global sort. Ids are compared as long throughout. An id that many rows share is
    divided by a hash of the text.
    """
    h = F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = key_ranges(docs, rows_a_range)
    firsts = _firsts(docs.select(keyed().alias("key"), (h if ranges.divided else F.lit(0).cast("long")).alias("h")), ranges)
    filled = sorted(firsts)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}
    first_key, first_h = np.full(len(ranges), NO_KEY), np.zeros(len(ranges), np.int64)
    for p, (k, x) in firsts.items():
        first_key[p], first_h[p] = k, x
    divided = ranges.divided

    @lean
    def dealt(batches):
        pack, sent = zstandard.ZstdCompressor(level=3), set()
        for batch in sliced(batches):
            docs_, hs = batch.column(0), np.asarray(batch.column(2))
            keys = np.asarray(docs_.fill_null(NO_KEY))
            parts = ranges.of(keys, hs)
            z = [pack.compress(t.encode("utf-8", "surrogatepass")) if t else b"" for t in batch.column(1).to_pylist()]
            leads = np.flatnonzero((keys == first_key[parts]) & ((hs == first_h[parts]) | (not divided))).tolist()
            leads = [i for i in leads if (mark := (int(parts[i]), z[i])) not in sent and not sent.add(mark)]  # equal rows once a task
            at = np.r_[np.arange(len(keys)), np.array(leads, np.int64)].astype(np.int64)
            to = np.r_[parts, np.array([before[int(parts[i])] for i in leads], np.int64)].astype(np.int32)
            tail = np.arange(len(at)) >= len(keys)
            yield pa.record_batch([pa.array(to), docs_.take(pa.array(at)), pa.array([z[i] for i in at.tolist()], pa.binary()), pa.array(tail), pa.array(hs[at])], names=["part", "doc_id", "z", "tail", "h"])

    rows = docs.select("doc_id", "text", h.alias("h")).mapInArrow(dealt, "part int, doc_id long, z binary, tail boolean, h long").repartition("part")
    return rows.sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "h", "z").select("part", "doc_id", "z", "tail").mapInArrow(_compared, OUT)


def op6_digest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(compare_edited(docs), "edited")
    rows = confirmed(docs, rows, {"edited_digest": "edited_form"})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
