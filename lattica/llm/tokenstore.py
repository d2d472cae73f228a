"""Token ids as binary blocks with a minimal perfect hash index from key to place.

Documents are encoded as they are read and their ids dealt by ranges of doc_id into shards;
each shard is written in order as blocks of about BLOCK_IDS ids, one Parquet row a block, so
Spark's commit protocol guards the files and any reader Spark has can fetch them. A block holds

    shard, part      its place in the order
    n_ids            ids in it
    payload          raw ids, little endian, uint16 if the vocabulary allows it, else uint32
    keys             the distinct doc_ids, int64
    sizes, bits      level sizes and bit vectors of the minimal perfect hash over the keys
    ranks            bits set before each 64-bit word
    prints           by slot: 32-bit fingerprint of the key
    records          by slot: first record and number of records of the key (repeated rows)
    offsets          by record: first id, and at the end n_ids

A key's slot is the rank of its bit in the first level that holds it; the stored fingerprint
tells foreign keys. A look-up touches one slot, whatever the size of the block.

Null texts are empty: the end id alone. Null ids have the key -2**63 and come first. Rows of
one doc_id are records of one key, in order of a hash of their ids; a key with many rows goes
on over blocks and shards, so no block is larger than BLOCK_IDS and one document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_KEY, Ranges, key_ranges, lean, materialize, sliced, table
from .wordpieces import WordPieces

BLOCK_IDS = 4_000_000
SHARD_ROWS = 4096
GAMMA = 1.5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: splitmix64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Levels of bit vectors; a key's bit is in the first level where no other key met it."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray | None = None):
        self.sizes, self.bits = sizes, bits
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        counts = np.bitwise_count(bits).astype(np.int64)
        self.ranks = ranks if ranks is not None else (np.cumsum(counts) - counts).astype(np.uint32)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        left, sizes, words = keys, [], []
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~once[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (self.ranks[at >> 6].astype(np.int64) + below)[here]
            left = left[~here]
        return out


def block(shard: int, part: int, keys: list[int], rows: list[bytes], dtype: np.dtype) -> dict:
    """keys: of each record, equal ones together."""
    own = np.array(keys, np.int64)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    distinct = own[first]
    mph = PerfectHash.of(distinct.view(np.uint64))
    slots = mph.slots(distinct.view(np.uint64))
    prints, records = np.zeros(len(distinct), np.uint32), np.zeros((len(distinct), 2), np.uint32)
    prints[slots] = mixed(distinct.view(np.uint64), 1000).astype(np.uint32)
    records[slots, 0], records[slots, 1] = first, np.diff(np.r_[first, len(own)])
    offsets = np.r_[0, np.cumsum([len(r) // dtype.itemsize for r in rows])].astype("<u8")
    raw = {"keys": distinct, "sizes": mph.sizes, "bits": mph.bits, "ranks": mph.ranks, "prints": prints, "records": records, "offsets": offsets}
    return {"shard": shard, "part": part, "n_ids": int(offsets[-1]), "width": dtype.itemsize, "payload": b"".join(rows)} | {k: v.tobytes() for k, v in raw.items()}


class Block:
    """Keyed access to one stored block."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.keys, self.prints = get("keys", np.int64), get("prints", np.uint32)
        self.records, self.offsets = get("records", np.uint32).reshape(-1, 2), get("offsets", "<u8").astype(np.int64)
        self.payload = get("payload", "<u2" if row["width"] == 2 else "<u4")
        self.mph = PerfectHash(get("sizes", np.int64), get("bits", np.uint64), get("ranks", np.uint32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each int64 key, -1 for keys that are not in the block."""
        own = keys.view(np.uint64)
        slots = self.mph.slots(own)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == mixed(own[there], 1000).astype(np.uint32)
        return np.where(there, slots, -1)

    def read(self, slot: int) -> list[tuple[int, np.ndarray]]:
        """(first id's place in the block, ids) of each record of a slot."""
        first, n = self.records[slot].tolist()
        return [(int(a), self.payload[a:b]) for a, b in zip(self.offsets[first : first + n].tolist(), self.offsets[first + 1 : first + n + 1].tolist(), strict=True)]


BINARY = ("payload", "keys", "sizes", "bits", "ranks", "prints", "records", "offsets")
SCHEMA = "shard int, part int, n_ids long, width int, " + ", ".join(f"{c} binary" for c in BINARY)


def shards(docs: DataFrame, rows_a_shard: int = SHARD_ROWS) -> Ranges:
    return key_ranges(docs, rows_a_shard)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, ranges: Ranges) -> DataFrame:
    """shard, key, h, ids (raw, ended by end_id), width of every row of docs(doc_id, text)."""

    @lean
    def run(batches):
        encoder = WordPieces(tokenizer)  # of this task alone: a worker that lives on doesn't keep its words
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in sliced(batches):
            rows = [raw + end for raw in encoder.encode(batch.column(1).to_pylist())]
            keys, hs = np.asarray(batch.column(0).fill_null(NO_KEY)), np.array([xxhash.xxh64_intdigest(r) for r in rows], np.uint64).view(np.int64)
            columns = [pa.array(ranges.of(keys, hs).astype(np.int32)), pa.array(keys), pa.array(hs), pa.array(rows, pa.binary()), pa.array(np.full(len(rows), width, np.int32))]
            yield pa.record_batch(columns, names=["shard", "key", "h", "ids", "width"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "shard int, key long, h long, ids binary, width int")


def blocks(docs: DataFrame, tokenizer: str, end_id: int, ranges: Ranges) -> DataFrame:
    """The blocks of docs(doc_id, text), every id list ended by end_id."""
    dealt = encoded(docs, tokenizer, end_id, ranges).repartition("shard").sortWithinPartitions("shard", "key", "h", "ids")

    @lean
    def run(batches):
        types = {"shard": pa.int32(), "part": pa.int32(), "n_ids": pa.int64(), "width": pa.int32()} | dict.fromkeys(BINARY, pa.binary())

        def flush():
            made = block(shard, part, keys, rows, np.dtype("<u2" if width == 2 else "<u4"))
            return pa.record_batch([pa.array([made[k]], t) for k, t in types.items()], names=list(types))

        shard, part, keys, rows, size, width = None, 0, [], [], 0, 2
        for batch in sliced(batches):
            for s, key, raw, width in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if keys and (s != shard or size + len(raw) > BLOCK_IDS * width):
                    yield flush()
                    part, keys, rows, size = (part + 1 if s == shard else 0), [], [], 0
                shard = s
                keys.append(key)
                rows.append(raw)
                size += len(raw)
        if keys:
            yield flush()

    return dealt.mapInArrow(run, SCHEMA)


def stored_documents(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, each read through the index of its block."""

    @lean
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                own, out = Block(row), []
                slots = own.find(own.keys)
                for key, slot in zip(own.keys.tolist(), slots.tolist(), strict=True):
                    for start, ids in own.read(slot):
                        out.append((row["shard"], row["part"], None if key == NO_KEY else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["shard", "part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = stored.mapInArrow(run, "shard int, part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    totals = {r["shard"]: r["n"] for r in stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # at most 20,000 shards
    before, bases = 0, []
    for shard in sorted(totals):
        bases.append((shard, before))
        before += totals[shard]
    inner = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.select("shard", "part", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("inner"))
    bases = stored.sparkSession.createDataFrame(bases, "shard int, base long")
    placed = rows.join(parts.join(bases, "shard"), ["shard", "part"])
    return placed.select("doc_id", (F.col("start") + F.col("inner") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def lookup(stored: DataFrame, keys: DataFrame, ranges: Ranges) -> DataFrame:
    """doc_id, ids (array) of those of keys(doc_id) that are stored. keys: any number, dealt by shard."""

    def dealt(batches):
        for batch in batches:
            rows = [(s, k) for k in batch.column(0).to_pylist() for s in ranges.spanned(k)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], []), (pa.int32(), pa.int64()), strict=True)], names=["shard", "doc_id"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().mapInArrow(dealt, "shard int, doc_id long")

    def run(left, right):
        import pandas as pd

        out = []
        for row in right.to_dict("records"):
            own = Block(row)
            asked = left["doc_id"].to_numpy(np.int64)
            for key, slot in zip(asked.tolist(), own.find(asked).tolist(), strict=True):
                out += [(key, ids.astype(np.int64)) for _, ids in own.read(slot)] if slot >= 0 else []
        return pd.DataFrame(out, columns=["doc_id", "ids"])

    found = stored.join(wanted.select("shard").distinct(), "shard", "left_semi")
    return wanted.groupBy("shard").cogroup(found.groupBy("shard")).applyInPandas(run, "doc_id long, ids array<long>")


def op8_tokenstore(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    stored = materialize(blocks(docs, public_tokenizers.path("word_bpe_49k.json"), 2, shards(docs)), "tokens")
    return stored_documents(stored)
