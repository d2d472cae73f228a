"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every operator of this package.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


#: Most rows and bytes of an Arrow batch. Documents are large, and a batch is held on both sides of the socket.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def frugal(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, where it has set none of its own."""
    for key, usual, wanted in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now == usual or usual is None and int(str(now or 0).rstrip("b") or 0) in (0, 64 << 20, (1 << 31) - 1):
            spark.conf.set(key, str(wanted))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, to be worked on in small batches."""
    frugal(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one beside the warehouse; in local mode a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="spark-") if re.match(r"local(\[|$)", sc.master) else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    made: gets the table's path, for discard.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release()
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that nothing reads any more: all that was made of them is written itself."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made.clear()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sliced(batches, rows: int = 1000):
    """The Arrow batches of a task in pieces of at most rows rows, so that few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run):
    """run, a function on the Arrow batches of a task, that gives memory back when the task ends: workers live on between stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Returns what Arrow's and the C library's allocators hold but don't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Longest word, in bytes, that tabulated takes.
TABULATED = 32


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[np.zeros(int(inside[:1].any()), np.int64), edges, np.full(int(inside[-1:].any()), len(inside))]
    return edges[::2], edges[1::2]


def tabulated(raw: np.ndarray, ends: np.ndarray, sizes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The exclusive or of tables[distance to the word's last byte, byte] over the bytes of each word of 1 to TABULATED bytes."""
    order = np.argsort(-sizes.astype(np.int8), kind="stable")  # the longest first: those that have one more byte come first
    at, out = ends[order] - 1, np.zeros(len(order), tables.dtype)
    times = np.bincount(sizes, minlength=1)
    for d, n in enumerate((len(order) - np.cumsum(times))[:-1].tolist()):
        out[:n] ^= tables[d].take(raw.take(at[:n]))
        at[:n] -= 1
    now = np.empty_like(out)
    now[order] = out
    return now


#: The key of rows without one: they come first.
NO_KEY = -(1 << 63)


class Ranges:
    """Ranges of (long key, hash of the row) in order, by their bounds.

    A bound begins a range. A key that is a bound several times fills as many ranges, which
    divide its rows by the hash.
    """

    def __init__(self, bounds: list[int]):
        self.bounds = np.array(sorted(bounds), np.int64)
        self.divided = bool((self.bounds[1:] == self.bounds[:-1]).any())

    def __len__(self) -> int:
        return len(self.bounds) + 1

    def of(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.bounds, keys, side) for side in ("left", "right"))
        out, times = low + (high > low), high - low
        many = np.flatnonzero(times > 1)
        if len(many):
            places = (hashes[many].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
            out[many] += ((places * times[many].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        return out

    def spanned(self, key: int) -> range:
        """The ranges that rows of a key may be in."""
        low, high = (int(np.searchsorted(self.bounds, key, side)) for side in ("left", "right"))
        return range(low + (high > low), high + 1)


def keyed(key: str = "doc_id") -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))


def key_ranges(df: DataFrame, rows: int, key: str = "doc_id", most: int = 20_000) -> Ranges:
    """Ranges of about rows rows each, at most `most` of them. Bounds are long; only how evenly they lie depends on the sketch."""
    own = F.col(key).cast("long")
    n, there, low = df.agg(F.count(F.lit(1)), F.count(own), F.min(own)).first()
    rows = max(rows, -(-n // most))
    bounds = [NO_KEY] * ((n - there) // rows)
    k = there // rows
    if k > 1:
        probs = [i / k for i in range(1, k)]
        above = (own.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double")  # from the least key on, so that close keys stay apart
        q = df.where(own.isNotNull()).agg(F.percentile_approx(above, probs, max(10_000, 20 * k)).alias("q")).first()["q"]
        bounds += [min(low + int(x), (1 << 63) - 1) for x in q]
    return Ranges(bounds)


class KeyFilter:
    """Says of long keys whether a table may have them: a bitmap of 16 bits a key, MOST_BITS at most, so its size is bounded.

    Beyond that it lets more keys through; whoever asks joins afterwards.
    """

    MOST_BITS = 1 << 27

    def __init__(self, spark: SparkSession, bitmap: np.ndarray, bits: int):
        self.bits, self.sent = bits, spark.sparkContext.broadcast(bitmap)

    @staticmethod
    def place(keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)

    @classmethod
    def of(cls, df: DataFrame, key: str) -> KeyFilter:
        """df: a table that is written already, as it is read twice."""
        bits = min(cls.MOST_BITS, 1 << max(10, (16 * df.count()).bit_length()))

        def run(batches):
            for batch in batches:
                yield pa.record_batch([pa.array(np.unique(cls.place(np.asarray(batch.column(0)), bits)))], names=["at"])

        places = df.select(F.col(key).alias("key")).mapInArrow(run, "at long").distinct()
        places = places.groupBy(F.shiftright("at", 12).alias("block")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << 12) - 1)).cast("int")).alias("ats"))
        bitmap = np.zeros(bits >> 3, np.uint8)
        for r in places.toLocalIterator():  # at most MOST_BITS numbers
            ats = np.array(r["ats"], np.int64) + (r["block"] << 12)
            np.bitwise_or.at(bitmap, ats >> 3, (1 << (ats & 7)).astype(np.uint8))
        return cls(df.sparkSession, bitmap, bits)

    def done(self) -> None:
        """Frees it on all machines, once all that asks it is written."""
        self.sent.destroy()

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys, self.bits)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph in edges(src, dst), ids of any one orderable type.

    Alternates large-star and small-star rounds until the edges stop changing; each round is
    checkpointed. Returns node, component (the smallest id reachable) for every node that has
    an edge to another one; self loops and nulls add nothing.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = None
    for _ in range(most_rounds):
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if sign == seen or sign[0] == 0:
            break
        seen = sign
        both = e.union(e.select("dst", "src"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("m", "src").alias("m"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").union(low)
        e = cut(small.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    else:
        raise RuntimeError(f"no convergence in {most_rounds} rounds")
    nodes = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.union(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
