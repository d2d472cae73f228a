"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are 64 bits over word shingles. Distinct fingerprints are compared inside
buckets: the bits are cut into six bands, and two fingerprints that differ in at most four
bits agree on at least two whole bands, so every link meets in one of the fifteen band pairs.
A bucket larger than BLOCK is cut into blocks by hash and every pair of blocks is a task of
its own, so no group is ever held whole. Inside a block the bits stand vertically (one plane
a bit); distances of many pairs are counted at once by carry-save counters over the planes,
and a block is abandoned once all its lanes exceed the radius. A block returns a spanning
forest of its links, which is enough for the components.

For near copies by word shingles (`near_copies`) 64 bits can't tell a similarity of 0.8. There
the fingerprint has WIDE_BITS signs of random projections of the five-word shingles, and the
bit-sliced comparison only finds candidates: texts meet in tables of band_bits(n) bits, which
grow with the number n of texts, so a bucket's size does not; a bucket returns the least
spanning forest of its pairs within WIDE_RADIUS, nearest first; and each of its edges is then
held against the exact Jaccard similarity of the two texts' shingles. Only those of 0.8 or more
link. Every pair of 0.8 meets with a probability of FOUND or more.

Nulls and empty texts have fingerprint zero and link like any other. Rows without a doc_id
are fingerprinted but belong to no component (null). Repeated rows share a component.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, connected_components, cut, discard, lean, materialize, sliced, table

BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
RADIUS = 4
BLOCK = 2048
SMALL = 48


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *(ends[: len(tokens) - words]).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    n, ones = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, n, 65536):
        part = values[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


WIDE = 4
WIDE_BITS = 64 * WIDE
#: At similarity 0.8 the cosine is 0.889, and a sign differs with a probability of 0.1515.
SIMILARITY, DIFFERS, FOUND = 0.8, 0.1515, 0.99
#: 38.8 of 256 bits are expected there and 9.7 of the first 64; both radii leave 3.5 times the spread.
WIDE_RADIUS, WIDE_FIRST = 59, 20
_SPREAD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) for i in range(WIDE_BITS // 8)], np.uint64)


def tokens_of(text: str | None) -> bytes:
    """The words as they are compared: A-Z in lower case, one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(joined: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of tokens (fewer words: the whole; none: no shingle)."""
    if not joined:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(spaces) < words:
        return np.array([digest(joined, seed)], np.uint64)
    starts, ends = [0, *(spaces[: len(spaces) + 1 - words] + 1).tolist()], [*spaces[words - 1 :].tolist(), len(joined)]
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64))


def wide_fingerprint(values: np.ndarray) -> bytes:
    """WIDE_BITS signs of sums over the shingles' hashes, each spread to WIDE_BITS numbers of -128 to 127."""
    sums = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096, None] * _SPREAD
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(29)
        sums += part.view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * sums + len(values) > 0, bitorder="little").tobytes()


def text_keys(joined: list[bytes]) -> list[np.ndarray]:
    """128 bits of each text, as two signed longs."""
    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in joined), np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(raw[:, i]) for i in (0, 1)]


def _raw_keys() -> tuple:
    """128 bits of the text as it is: with the doc_id, the key of a row; equal rows share it."""
    return F.xxhash64("text").alias("r1"), F.xxhash64(F.lit(1), "text").alias("r2")


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, r1, r2 (key of the text), k1, k2 (key of its words) and bits of every row of docs(doc_id, text)."""

    @lean
    def run(batches):
        for batch in sliced(batches, 256):
            joined = [tokens_of(t) for t in batch.column(1).to_pylist()]
            bits = [wide_fingerprint(shingles(x, words)) for x in joined]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), *map(pa.array, text_keys(joined)), pa.array(bits, pa.binary())], names=["doc_id", "r1", "r2", "k1", "k2", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *_raw_keys())
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, k1 long, k2 long, bits binary")


def band_bits(n: int) -> tuple[int, int]:
    """(bits of a table's key, tables): buckets of random texts stay small at any n, and a pair of SIMILARITY meets with probability FOUND."""
    bits = max(14, min(30, math.ceil(math.log2(max(n, 1))) - 4))
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - DIFFERS) ** bits))


def _banded(n: int):
    bits, tables = band_bits(n)
    draw, weights = np.random.default_rng(7), np.zeros((WIDE_BITS, tables))
    for t in range(tables):
        weights[draw.choice(WIDE_BITS, bits, replace=False), t] = 2.0 ** np.arange(bits)

    def run(batches):
        for batch in sliced(batches, 4096):
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE_BITS // 8)
            keys = (np.unpackbits(raw, axis=1, bitorder="little").astype(np.float64) @ weights).astype(np.int64) + (np.arange(tables) << 32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(keys), pa.list_(pa.int64()))], names=["fp", "bits", "buckets"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs(doc_id, text)."""

    @lean
    def run(batches):
        for batch in sliced(batches):
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _counted(diffs, lanes_shape, radius: int):
    """Lanes whose set bits over all planes are at most radius, as packed words. diffs: planes of equal shape."""
    width = max(1, radius.bit_length())
    sums = [np.zeros(lanes_shape, np.uint64) for _ in range(width)]
    over = np.zeros(lanes_shape, np.uint64)
    bits = [(radius >> i) & 1 for i in range(width)]
    for k, plane in enumerate(diffs):
        carry = plane
        for i in range(width):
            sums[i], carry = sums[i] ^ carry, sums[i] & carry
        over |= carry
        if k % 8 == 7:
            gone = over | _above(sums, bits)
            if bool((~gone == 0).all()):
                return ~gone
    return ~(over | _above(sums, bits))


def _above(sums, bits):
    """Lanes whose counter is greater than the constant in bits."""
    above, equal = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for s, b in zip(reversed(sums), reversed(bits), strict=True):
        if not b:
            above |= equal & s
            equal &= ~s
        else:
            equal &= s
    return above


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of uint64 values, 64 lanes a word, zero padded."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_lanes(xors: np.ndarray, radius: int) -> np.ndarray:
    """For each XOR of a pair whether it has at most radius bits."""
    out = np.zeros(len(xors), bool)
    for at in range(0, len(xors), 1 << 16):
        part = xors[at : at + (1 << 16)]
        planes = _planes(part)
        ok = _counted(planes, planes.shape[1:], radius)
        out[at : at + len(part)] = np.unpackbits(ok.view(np.uint8), bitorder="little")[: len(part)].astype(bool)
    return out


def near_block(left: np.ndarray, right: np.ndarray, radius: int):
    """Yields (i, js): the right values within radius of left[i], right in bit planes."""
    planes = _planes(right)
    full = ~np.uint64(0)
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        flips = [np.where((rows >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None] for b in range(64)]
        ok = _counted((planes[b][None, :] ^ flips[b] for b in range(64)), (len(rows), planes.shape[1]), radius)
        hit = np.unpackbits(ok.view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
        for i in np.flatnonzero(hit.any(axis=1)):
            yield at + int(i), np.flatnonzero(hit[i])


def _forest(i: np.ndarray, j: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs of n rows make a least spanning forest, nearest first."""
    up, taken = np.arange(n), []
    for d in np.unique(distance):
        left = np.flatnonzero(distance == d)
        while len(left):
            a, b = up[i[left]], up[j[left]]
            apart = a != b
            left, a, b = left[apart], a[apart], b[apart]
            high, which = np.unique(np.maximum(a, b), return_index=True)
            up[high] = np.minimum(a, b)[which]
            taken.append(left[which])
            while not np.array_equal(up, higher := up[up]):
                up = higher
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _linked(keys: np.ndarray, side: np.ndarray, ids: np.ndarray, bits: np.ndarray, first: int, radius: int):
    """The least spanning forests of whole buckets; rows sorted by key. side: 0 and 1 in a pair of blocks, 2 in a bucket of one block.

    bits: (rows, words); pairs within first bits in the first word link if all words differ in at most radius bits.
    """
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cuts, len(keys)])
    found: list[tuple] = []

    def add(i, j):
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int64)
        near = d <= radius
        if near.any():
            found.append((i[near], j[near], d[near]))

    for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        step = max(1, (1 << 18) // int(m * m))
        own = cuts[sizes == m]
        for at in range(0, len(own), step):
            rows = own[at : at + step, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            if side[a[0]] != 2 or not (side[a] == 2).all():  # of a pair of blocks only pairs across
                across = (side[a] == 2) | (side[a] != side[b])
                a, b = a[across], b[across]
            ok = np.flatnonzero(near_lanes(bits[a, 0] ^ bits[b, 0], first))
            add(a[ok], b[ok])
    for k in np.flatnonzero(sizes > SMALL):
        part = np.arange(cuts[k], cuts[k] + sizes[k])
        own = side[cuts[k]] == 2
        left, right = (part, part) if own else (part[side[part] == 0], part[side[part] == 1])
        for i, js in near_block(bits[left, 0], bits[right, 0], first):
            js = right[js[js > i] if own else js]
            add(np.full(len(js), left[i]), js)
    if not found:
        return (np.zeros(0, np.int64),) * 2
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    rows, places = np.unique(np.r_[i, j], return_inverse=True)  # only rows that have a pair
    taken = _forest(places[: len(i)], places[len(i) :], d, len(rows))
    return ids[i[taken]], ids[j[taken]]


def _links_of(first: int, radius: int):
    @lean
    def run(batches):
        held = None

        def links(keys, side, ids, bits):
            src, dst = _linked(keys, side, ids, bits, first, radius)
            return pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1) if batch.num_rows else None
            if words is None:
                continue
            now = [*(np.asarray(batch.column(i)) for i in range(3)), words]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            held = [x[last:] for x in now]
            if last:
                yield links(*(x[:last] for x in now))
        if held is not None:
            yield links(*held)

    return run


def _bucket_links(rows: DataFrame, first: int, radius: int) -> DataFrame:
    """Spanning links (src, dst) of rows(fp, bits, bucket) inside their buckets."""
    large = rows.groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"), F.when(own == o, 2).when(own < o, 0).otherwise(1).cast("byte").alias("side")),
    )
    rows = rows.select("fp", "bits", "bucket", F.explode(others).alias("o"))
    key = F.when((F.col("o.lo") == 0) & (F.col("o.hi") == 0), F.col("bucket")).otherwise(F.xxhash64("bucket", "o.lo", "o.hi"))
    rows = rows.select(key.alias("key"), F.col("o.side").alias("side"), "fp", "bits")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links_of(first, radius), "src long, dst long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (src, dst) between the distinct fingerprints of fps(fp) that differ in at most radius bits."""
    if radius > RADIUS:
        raise ValueError(f"the bands serve a radius of {RADIUS} at most")
    bits = lambda at, n: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    tables = []
    for t, (i, j) in enumerate(combinations(range(len(BANDS)), 2)):
        (a, n), (b, m) = BANDS[i], BANDS[j]
        tables.append(F.lit(t << 40).cast("long") + F.shiftleft(bits(a, n), m) + bits(b, m))
    raw = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # bytes in any one order
    return _bucket_links(fps.select("fp", F.explode(F.array(*tables)).alias("bucket")).withColumn("bits", raw), radius, radius)


def _components(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable."""
    parts = connected_components(links)
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # a fingerprint that many copies share may hold a third of the rows: AQE splits either join
    found = named.join(least, "component").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _alike(batches):
    for batch in sliced(batches):
        left, right = (batch.column(i).to_pylist() for i in (2, 3))
        same = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= SIMILARITY for a, b in zip(left, right, strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(same, pa.bool_()))


def verified(docs: DataFrame, texts: DataFrame, links: DataFrame, words: int = 5, made: list[str] | None = None) -> DataFrame:
    """The links (src, dst) between nodes of texts(node, k1, k2) whose texts have a similarity of SIMILARITY or more.

    Only texts with a link are read again, by a filter of bounded size on the scan, and each is sent once a task.
    """
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ends = materialize(ends.join(texts, "node").select("node", "k1", "k2"), "ends", made)
    wanted = KeyFilter.of(ends, "k1")

    @lean
    def run(batches):
        sent: set[tuple[int, int]] = set()
        for batch in sliced(batches, 256):
            joined = [tokens_of(t) for t in batch.column(0).to_pylist()]
            k1, k2 = text_keys(joined)
            rows = []
            for i in np.flatnonzero(wanted.may_have(k1)).tolist():
                key = (int(k1[i]), int(k2[i]))
                if key not in sent:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(key)
                    rows.append((*key, shingles(joined[i], words).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["k1", "k2", "set"])

    sets = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k1 long, k2 long, set binary")
    sets = materialize(sets.join(ends, ["k1", "k2"]).groupBy("node").agg(F.first("set").alias("set")), "shingles", made)
    pairs = links.join(sets.select(F.col("node").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("node").alias("dst"), F.col("set").alias("b")), "dst")
    return pairs.select("src", "dst", "a", "b").mapInArrow(_alike, "src long, dst long")


def near_copies(docs: DataFrame, words: int = 5, made: list[str] | None = None) -> DataFrame:
    """doc_id, r1, r2, component of every row: groups of documents over links of a similarity of 0.8 or more in shingles of words words."""
    rows = materialize(wide_fingerprints(docs, words), "widehash", made)
    texts = cut(rows.groupBy("k1", "k2").agg(F.first("bits").alias("bits")).withColumn("node", F.monotonically_increasing_id()))
    banded = texts.select("node", "bits").mapInArrow(_banded(texts.count()), "fp long, bits binary, buckets array<long>")
    links = _bucket_links(banded.select("fp", "bits", F.explode("buckets").alias("bucket")), WIDE_FIRST, WIDE_RADIUS)
    links = materialize(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "candidates", made)
    parts = connected_components(verified(docs, texts.select("node", "k1", "k2"), links, words, made))
    named = texts.select("node", "k1", "k2").join(parts, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "r1", "r2", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "r1", "r2", "component")


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (rows without one last), of equal ids the least key.

    Rows that repeat a kept one, id and text alike, go too; they are the only ones that are shuffled whole.
    """
    made: list[str] = []
    found = materialize(near_copies(docs, words, made), "copies")
    discard(docs.sparkSession, made)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("best"))
    each = found.groupBy("doc_id", "r1", "r2", "component").agg(F.count("*").alias("n")).join(best, "component")
    here = F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")
    marked = each.select("doc_id", "r1", "r2", F.when(here == F.col("best"), F.when(F.col("n") > 1, 1)).otherwise(0).alias("mark")).where("mark is not null")
    marked = materialize(marked, "marked")  # a row for each text that goes and each that repeats
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names may clash with ours
    own = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("row", "doc_id", *_raw_keys())
    same = lambda m: own["doc_id"].eqNullSafe(m["doc_id"]) & (own["r1"] == m["r1"]) & (own["r2"] == m["r2"])
    single = own.join(marked, same(marked), "left_anti").select("row")
    repeated = marked.where("mark = 1")
    repeated = own.join(repeated, same(repeated), "left_semi").groupBy("doc_id", "r1", "r2").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select(*(F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)))


def simhash_components(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most radius bits."""
    rows = materialize(fingerprints(docs, words), "simhash")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    return _components(rows, distinct, fingerprint_links(distinct.select("fp"), radius))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
