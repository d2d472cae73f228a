"""Best-fit packing by patterns fitted with non-negative least squares.

Token lengths form a histogram of at most `capacity` bins, whatever the size of the corpus.
Patterns of two to four lengths that fill a sequence are enumerated, their repeat counts
fitted to the histogram by non-negative least squares, rounded down to what is there, and
what is left is packed best-fit by runs of equal lengths. The plan is a table of runs
(length, rank from, count, sequence from, offset); each piece finds its place by its rank
among the pieces of its length. Ranks are dealt by (length, hash), so a length that a third
of all pieces share is spread over all tasks.

Null and empty texts are one piece, the end id alone. Repeated rows are packed as often as
they occur. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, sliced, table
from .wordpieces import WordPieces

CAPACITY = 2048
PARTNERS = 24
ROUNDS = 150


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian uint32) of docs(doc_id, text)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @lean
    def run(batches):
        encoder = WordPieces(tokenizer)  # of this task alone: a worker that lives on doesn't keep its words
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, raw in zip(ids, encoder.encode(texts), strict=True):
                tokens = np.append(np.frombuffer(raw, encoder.dtype), end_id).astype("<u4")
                for k, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at : at + capacity]
                    data = part.tobytes()
                    rows.append((doc, k, at, len(part), zlib.crc32(data), *[data] * with_ids))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """(n, 4) lengths, zero for none, each row summing to capacity, all lengths present."""
    there = np.flatnonzero(histogram[:capacity])
    there = there[there > 0]
    if not len(there):
        return np.zeros((0, 4), np.int64)
    has = np.zeros(capacity + 1, bool)
    has[there] = True
    often = there[np.argsort(-histogram[there], kind="stable")[:PARTNERS]]
    spread = there[np.linspace(0, len(there) - 1, min(PARTNERS, len(there))).astype(int)]
    partners = np.unique(np.r_[often, spread])
    found = [np.stack([there, capacity - there, 0 * there, 0 * there], 1)]
    a, b = (x.ravel() for x in np.meshgrid(there, partners))
    found.append(np.stack([a, b, capacity - a - b, 0 * a], 1))
    pairs = np.stack([x.ravel() for x in np.meshgrid(partners, partners)], 1)
    pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    pairs = pairs[np.linspace(0, len(pairs) - 1, min(len(pairs), 200)).astype(int)]
    a, k = (x.ravel() for x in np.meshgrid(there, np.arange(len(pairs))))
    found.append(np.stack([a, pairs[k, 0], pairs[k, 1], capacity - a - pairs[k].sum(1)], 1))
    rows = np.concatenate(found)
    last = np.where(rows[:, 3] != 0, rows[:, 3], np.where(rows[:, 2] != 0, rows[:, 2], rows[:, 1]))
    rows = rows[(last > 0) & (rows >= 0).all(1) & (rows.sum(1) == capacity)]
    rows = rows[(has[rows] | (rows == 0)).all(1)]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def repeats(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares: x >= 0 near the least |A x - histogram|, by accelerated projected gradients."""
    weight = 1 / np.sqrt(np.maximum(histogram, 1.0))  # rare lengths count as much as frequent ones
    used = (rows > 0).astype(float)
    goal = histogram * weight
    apply = lambda x: np.bincount(rows.ravel(), (used * x[:, None]).ravel(), len(histogram)) * weight
    back = lambda r: ((r * weight)[rows] * used).sum(1)
    probe = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue of A'A
        probe = back(apply(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(apply(y) - goal) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, rank from, count, sequence from, offset), sorted, and the number of sequences."""
    left = histogram.astype(np.int64).copy()
    bins: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        bins.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = patterns(left, capacity)
    if len(rows):
        x = repeats(rows, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min(np.floor(x[k]), (left[lengths] // times).min()))
            if n > 0:
                bins.append((tuple(rows[k][rows[k] > 0].tolist()), n))
                left[lengths] -= n * times
    bins += _best_fit(left, capacity)
    runs, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in bins:
        at = 0
        for length in lengths:
            runs.append((length, int(rank[length]), n, sequence, at))
            rank[length] += n
            at += length
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequence


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over runs of equal lengths: the open bins of one space and content are one entry."""
    spaces: dict[int, list[list]] = {}  # by space left: [content, bins]
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            space = next((s for s in range(length, capacity) if spaces.get(s)), None)
            if space is None:
                space, entry = capacity, [(), n]
            else:
                entry = spaces[space].pop()
            each = min(space // length, n)
            k = min(entry[1], n // each)
            if space < capacity and entry[1] > k:
                spaces.setdefault(space, []).append([entry[0], entry[1] - k])
            spaces.setdefault(space - each * length, []).append([entry[0] + (length,) * each, k])
            n -= k * each
    return [(content, n) for entries in spaces.values() for content, n in entries]


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be the same rows each time it is read."""
    counted = pieces.groupBy("length").count().collect()  # at most capacity rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["count"]
    runs, _ = plan(histogram, capacity)
    keys = (runs[:, 0] << 40) | runs[:, 1]
    salts = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    columns = [c for c in pieces.columns]
    ranked = ranked.select(*columns, (F.col("rank") + F.col("base")).cast("long").alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            found = [pa.array(runs[k, 3] + rank - runs[k, 1]), pa.array(runs[k, 4])]
            yield pa.record_batch([*(batch.column(i) for i in range(len(columns))), *found], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return assign(materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the whole packed sequences, of pack(with_ids=True)."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
