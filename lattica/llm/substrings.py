"""Substring dedup by relative Lempel-Ziv factors over an index of all documents.

Words are runs of anything but ASCII white space, unchanged. Every document is a reference:
its windows of `window` words are indexed by hash in blocks that Spark deals by key. Every
document is parsed against the whole index into literals and factors (reference document,
reference position, length): a window that the index holds elsewhere too, in the same document
or another, begins a factor, and the factor goes on greedily for as long as the next window
stands at the next place of the same reference. A document's factors travel together by
reference, as a text that repeats a short passage over and over has one every few words, all
of the same place: each word of the reference is sent once. The reference's words are then fetched and
compared word by word from one end of the factor to the other: hashes only propose. What is
equal for `window` words or more is a duplicate span.

Most windows are never shuffled. Each window elects an anchor, the least hash of its runs of
SEED words (leftmost on ties), so equal windows elect equal anchors; an anchor that occurs
once rules out all its windows. Consecutive windows of one anchor travel as one variant, with
all its places in a slice of documents, so a passage that a third of all documents share is a
row a slice; what is found of a slice's variants goes back to its documents together; the windows of equal variants are sent once a task. Anchors that occur twice are looked up in a bitmap of
bounded size; what it lets through in vain is found to be alone later.

Null texts have no words. Texts shorter than a window are kept whole. Null ids and repeated
rows are documents of their own: rows that repeat exactly are each other's duplicates. A row is
known by its id and 64 bits of its text; should two rows agree in both, a factor is still
compared with each one's own words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_KEY, TABULATED, WORD, KeyFilter, discard, keyed, lean, materialize, runs_of, sliced, table, tabulated

WINDOW = 35
SEED = 8
# An odd multiplier and the constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(steps)
    return _powers


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, of the hashes of the words."""
    n = len(words)
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=sums[1:])
        out = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        out ^= out >> np.uint64(29)
        out *= MIX
        return out ^ (out >> np.uint64(32))


#: 1 for all bytes but ASCII white space, as bytes.split has it.
NO_SPACE = bytes(b not in b" \t\n\v\f\r" for b in range(256))


@functools.cache
def _tables() -> np.ndarray:
    return np.array([[xxhash.xxh64_intdigest(bytes([d, b])) for b in range(256)] for d in range(TABULATED)], np.uint64)


def word_hashes(raws: list[bytes], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts one after the other, where each text's begin and the last one's end)."""
    raw = b"\n".join(raws)
    starts, ends = runs_of(np.frombuffer(raw.translate(NO_SPACE), bool))
    sizes, found = ends - starts, np.empty(len(starts), np.uint64)
    usual = np.flatnonzero(sizes <= TABULATED)
    found[usual] = tabulated(np.frombuffer(raw, np.uint8), ends[usual], sizes[usual], _tables())
    for i in np.flatnonzero(sizes > TABULATED).tolist():
        found[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    begin = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return found if bits == 64 else found & np.uint64((1 << bits) - 1), begin


def least_places(values: np.ndarray, k: int) -> np.ndarray:
    """The place of the least of every run of k values, the leftmost on ties."""
    at, size = np.arange(len(values)), 1
    while size < k:
        step = min(size, k - size)
        right = values[step:] < values[:-step]
        values, at, size = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step]), size + step
    return at


def anchored(words: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, texts, first windows, ends): windows first..end-1, by their first words among all, elect the anchor."""
    text = np.repeat(np.arange(len(begin) - 1), np.maximum(np.diff(begin) - window + 1, 0))
    if not len(text):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    seeds = rolled(words, min(SEED, window))
    whole = np.arange(len(text)) + (begin[:-1] - np.r_[0, np.cumsum(np.maximum(np.diff(begin) - window + 1, 0))[:-1]])[text]  # windows within a text
    at = least_places(seeds, window - min(SEED, window) + 1)[whole]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first = whole[new]
    return seeds[at[new]], text[new], first, first + np.diff(np.r_[new, len(at)])


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _few(texts: list, most: int = 500_000):
    """(number of the first, bytes of each) of the texts in runs of about most bytes."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(_encoded(t))
        size += len(run[-1])
        if size >= most or i + 1 == len(texts):
            yield first, run
            first, run, size = i + 1, [], 0


def _identified(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc, h (together the row's key; equal rows share it), text, and the extra columns as x0, x1, ..."""
    h = F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"))
    return docs.select(keyed().alias("doc"), h.alias("h"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra or [])))


def _anchors(window: int, bits: int):
    @lean
    def run(batches):
        for few in sliced(batches, 500):
            found = [anchored(*word_hashes(raws, bits), window)[0] for _, raws in _few(few.column(0).to_pylist())]
            anchors, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(anchors), pa.array(n)], names=["anchor", "n"])

    return run


FOUND = "slice long, vid long, places array<struct<doc:long,h:long,at:int>>, keys array<long>"


def _variants(window: int, wanted: KeyFilter, bits: int):
    @lean
    def run(batches):
        sent: set[int] = set()
        spot = TaskContext.get().partitionId() << 32
        place = pa.struct([("doc", pa.int64()), ("h", pa.int64()), ("at", pa.int32())])
        for k, few in enumerate(sliced(batches, 500)):
            rows: dict[int, list[tuple]] = {}
            windows: dict[int, np.ndarray] = {}
            ids = list(zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True))
            for base, raws in _few(few.column(2).to_pylist()):
                words, begin = word_hashes(raws, bits)
                anchors, text, first, end = anchored(words, begin, window)
                there = wanted.may_have(anchors.view(np.int64))
                if not there.any():
                    continue
                keys = rolled(words, window).view(np.int64)
                for a, i, j, t, at in zip(*(x[there].tolist() for x in (anchors, first, end, text, first - begin[text])), strict=True):
                    own = keys[i:j]
                    vid = xxhash.xxh64_intdigest(own.tobytes(), a & 0xFFFFFFFF)
                    vid -= (vid >> 63) << 64
                    if vid not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(vid)
                        windows[vid] = own.copy()
                    rows.setdefault(vid, []).append((*ids[base + t], at))
            if rows:
                flat = list(zip(*(p for places in rows.values() for p in places), strict=True))
                places = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, place, strict=True)], fields=list(place))
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in rows.values()])], pa.int32())
                columns = [pa.array([spot + k] * len(rows), pa.int64()), pa.array(list(rows), pa.int64()), pa.ListArray.from_arrays(offsets, places), pa.array([windows.get(v) for v in rows], pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["slice", "vid", "places", "keys"])

    return run


def _packed(batches):
    """Texts compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches, 500):
        z = [pack.compress(_encoded(t)) if t else b"" for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.binary()), *(batch.column(i) for i in range(3, batch.num_columns))], names=["doc", "h", "z", *batch.schema.names[3:]])


RUNS = "array<struct<at:int,n:int,rdoc:long,rh:long,rat:int>>"
RUN = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("rdoc", pa.int64()), ("rh", pa.int64()), ("rat", pa.int32())])


def _runs(batches):
    """doc, h, runs of rows (n, low, high, hits, places): the places of many variants, gathered by document."""
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        fields = lambda name: [np.asarray(c) for c in column[name].flatten()]
        places, hits = column["places"], column["hits"]
        row = np.repeat(np.arange(batch.num_rows), np.asarray(places.value_lengths()))
        doc, h, at = (np.asarray(c) for c in places.flatten().flatten())
        low, high = (np.stack([x.astype(np.int64) for x in fields(name)]) for name in ("low", "high"))
        ref = np.where((np.stack([doc, h, at]) == low[:, row]).all(axis=0), high[:, row], low[:, row])
        own = np.asarray(hits.is_null())[row]
        # windows that only other variants hold: a run of one each
        each = np.asarray(hits.value_lengths().fill_null(0)).astype(np.int64)
        first, alone = np.cumsum(each) - each, np.flatnonzero(~own)
        times = each[row[alone]]
        there = np.repeat(alone, times)
        nth = np.arange(len(there)) - np.repeat(np.cumsum(times) - times, times) + first[row[there]]
        k, rdoc, rh, rat = (np.asarray(c)[nth] for c in hits.flatten().flatten())
        long = [
            np.r_[doc[own], doc[there]], np.r_[h[own], h[there]], np.r_[at[own], at[there] + k], np.r_[np.asarray(column["n"])[row[own]], np.ones(len(there), np.int64)],
            np.r_[ref[0][own], rdoc], np.r_[ref[1][own], rh], np.r_[ref[2][own], rat],
        ]
        order = np.lexsort(long[::-1])
        long = [x[order] for x in long]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in long:
            new[1:] |= x[1:] != x[:-1]
        long = [x[new] for x in long]  # rows that repeat have equal runs
        start = np.flatnonzero(np.r_[True, (long[0][1:] != long[0][:-1]) | (long[1][1:] != long[1][:-1])]) if len(long[0]) else np.zeros(0, np.int64)
        structs = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(long[2:], RUN, strict=True)], fields=list(RUN))
        runs = pa.ListArray.from_arrays(pa.array(np.r_[start, len(long[0])], pa.int32()), structs)
        yield pa.record_batch([pa.array(long[0][start], pa.int64()), pa.array(long[1][start], pa.int64()), runs], names=["doc", "h", "runs"])


def indexed(rows: DataFrame, window: int = WINDOW, bits: int = 64, made: list[str] | None = None) -> DataFrame:
    """doc, h, runs: for each row of rows(doc, h, text) that has some, runs of n windows from at that the index holds elsewhere, from rat of (rdoc, rh).

    The reference of a variant is the least place it occurs at, for that place itself the
    greatest; that of a window which only other variants hold is such a variant's least place.
    """
    twice = rows.select("text").mapInArrow(_anchors(window, bits), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = KeyFilter.of(materialize(twice, "twice", made), "anchor")
    found = materialize(rows.select("doc", "h", "text").mapInArrow(_variants(window, wanted, bits), FOUND), "variants", made)
    low, high = F.min(F.array_min("places")).alias("low"), F.max(F.array_max("places")).alias("high")
    variants = found.groupBy("vid").agg(F.sum(F.size("places")).alias("times"), F.first("keys", ignorenulls=True).alias("keys"), low, high)
    variants = materialize(variants.withColumn("uid", F.monotonically_increasing_id()), "distinct", made)
    # a variant has at most window windows, so its number and a place in it make one long
    step = 1 << max(6, (window + 1).bit_length())
    each = variants.select("times", F.posexplode("keys").alias("k", "key"), "uid").select("times", "key", (F.col("uid") * step + F.col("k")).alias("code"))
    again = each.groupBy("key").agg(F.sum("times").alias("n"), F.min("code").alias("first"), F.max("code").alias("last")).where("n > 1").select("key", "first", "last")
    # joins on materialised tables, so that AQE can split a key which a third of the rows share
    single = each.where("times = 1").join(materialize(again, "again", made), "key")
    single = single.select("code", F.when(F.col("first") == F.col("code"), F.col("last")).otherwise(F.col("first")).alias("other"))
    split = lambda c: F.shiftright(c, step.bit_length() - 1)
    single = single.select(split("code").alias("mine"), F.pmod("code", F.lit(step)).cast("int").alias("k"), split("other").alias("uid"), F.pmod("other", F.lit(step)).cast("int").alias("rk"))
    there = single.join(variants.select("uid", "low"), "uid").select("mine", F.struct("k", F.col("low.doc").alias("rdoc"), F.col("low.h").alias("rh"), (F.col("low.at") + F.col("rk")).alias("rat")).alias("hit"))
    hits = there.groupBy(F.col("mine").alias("uid")).agg(F.collect_list("hit").alias("hits"))
    marks = variants.join(hits, "uid", "left").where("times > 1 or hits is not null").select("vid", F.size("keys").alias("n"), "low", "high", "hits")
    own = found.select("slice", "vid", "places").join(materialize(marks, "marks", made), "vid").select("slice", "n", "low", "high", "hits", "places")
    # dealt back by slice, so a document's runs are gathered where they meet: one row a document, not one a place
    runs = own.repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(_runs), f"doc long, h long, runs {RUNS}")
    return runs.groupBy("doc", "h").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def factors(runs: Iterable[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Greedy parse of runs (at, n, rdoc, rh, rat): factors (first word, words, rdoc, rh, first word there)."""
    out: list[list[int]] = []
    for at, n, rdoc, rh, rat in sorted(runs):
        last = out[-1] if out else None
        if last and last[0] + last[1] == at and (last[2], last[3], last[4] + last[1]) == (rdoc, rh, rat):
            last[1] += n
        else:
            out.append([at, n, rdoc, rh, rat])
    return [(at, n + window - 1, rdoc, rh, rat) for at, n, rdoc, rh, rat in out]


PART = "struct<at:int,n:int,rat:int>"
FACTORS = f"doc long, h long, rdoc long, rh long, parts array<{PART}>"
PARTS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("rat", pa.int32())]))


def referred(rows: DataFrame, window: int = WINDOW, bits: int = 64, made: list[str] | None = None) -> DataFrame:
    """doc, h, rdoc, rh, parts: every factor of every document, proposed by hashes; those of a document with one reference are one row."""

    @lean
    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), PARTS]
        for batch in sliced(batches):
            out = []
            for doc, h, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts: dict[tuple[int, int], list[dict]] = {}
                for at, n, rdoc, rh, rat in factors({tuple(r.values()) for r in runs}, window):
                    parts.setdefault((rdoc, rh), []).append({"at": at, "n": n, "rat": rat})
                out += [(doc, h, *ref, own) for ref, own in parts.items()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["doc", "h", "rdoc", "rh", "parts"])

    return indexed(rows, window, bits, made).mapInArrow(run, FACTORS)


def parse(rows: DataFrame, window: int = WINDOW, bits: int = 64) -> DataFrame:
    """doc, h, at, n, rdoc, rh, rat: the factors of referred, a row each."""
    return referred(rows, window, bits).select("doc", "h", "rdoc", "rh", F.inline("parts")).select("doc", "h", "at", "n", "rdoc", "rh", "rat")


def stretches(parts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The stretches (first word, word after the last) that parts (first word, words) cover, and where each part begins in them one after another."""
    joined: list[list[int]] = []
    places, before = [0] * len(parts), 0
    for i in sorted(range(len(parts)), key=parts.__getitem__):
        at, n = parts[i]
        if joined and at <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], at + n)
        else:
            before += joined[-1][1] - joined[-1][0] if joined else 0
            joined.append([at, at + n])
        places[i] = before + at - joined[-1][0]
    return [(a, b) for a, b in joined], places


def _quoted(batches):
    """The reference's words of the factors of each row, each word once, and where a factor's begin among them."""
    pack, opened, last, words = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), None, []
    for batch in sliced(batches, 500):
        out, placed = [], []
        for parts, z in zip(*(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
            if z != last:
                last, words = z, opened.decompress(z).split() if z else []
            covered, places = stretches([(p["rat"], p["n"]) for p in parts])
            out.append(pack.compress(b" ".join(w for a, b in covered for w in words[a:b])))
            placed.append([p | {"rat": at} for p, at in zip(parts, places, strict=True)])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(placed, PARTS), pa.array(out, pa.binary())], names=["doc", "h", "parts", "words"])


def quoted(rows: DataFrame, found: DataFrame, made: list[str] | None = None) -> DataFrame:
    """doc, h, quotes: (parts, words) of the factors found by reference, with the words that stand there; rat is a place among these words."""
    wanted = KeyFilter.of(found, "rh")

    @lean
    def run(batches):
        sent: set[tuple[int, int]] = set()
        for batch in sliced(batches, 500):
            here = []
            for i in np.flatnonzero(wanted.may_have(np.asarray(batch.column(1)))).tolist():
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key not in sent:  # rows that repeat are sent once
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(key)
                    here.append(i)
            if here:
                yield from _packed([batch.take(pa.array(here))])

    refs = rows.select("doc", "h", "text").mapInArrow(run, "doc long, h long, z binary")
    refs = refs.join(found.select(F.col("rdoc").alias("doc"), F.col("rh").alias("h")).distinct(), ["doc", "h"], "left_semi")
    refs = materialize(refs.groupBy("doc", "h").agg(F.first("z").alias("z")), "references", made).select(F.col("doc").alias("rdoc"), F.col("h").alias("rh"), "z")
    quotes = found.join(refs, ["rdoc", "rh"]).select("doc", "h", "parts", "z").mapInArrow(lean(_quoted), f"doc long, h long, parts array<{PART}>, words binary")
    return quotes.groupBy("doc", "h").agg(F.collect_list(F.struct("parts", "words")).alias("quotes"))


def unquoted(quotes: list[dict], opened) -> list[tuple[int, list[bytes]]]:
    """(first word, the words of its reference) of every factor in a document's quotes."""
    out = []
    for q in quotes:
        words = opened.decompress(q["words"]).split()
        out += [(p["at"], words[p["rat"] : p["rat"] + p["n"]]) for p in q["parts"]]
    return out


def spans(words: list[bytes], quotes: list[tuple[int, list[bytes]]], window: int) -> list[tuple[int, int]]:
    """The duplicate spans (first word, word after the last): where the words equal those quoted for a window or more."""
    out: list[list[int]] = []
    for at, there in sorted(quotes):
        own = words[at : at + len(there)]
        if own == there:
            equal = [(at, at + len(own))] if len(own) >= window else []
        else:
            breaks = [-1, *(i for i, (a, b) in enumerate(zip(own, there, strict=False)) if a != b), min(len(own), len(there))]
            equal = [(at + a + 1, at + b) for a, b in zip(breaks, breaks[1:], strict=False) if b - a - 1 >= window]
        for a, b in equal:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


def parsed(docs: DataFrame, render, schema: str, window: int = WINDOW, extra: list[str] | None = None, bits: int = 64) -> DataFrame:
    """render(bytes of the text, spans) -> tuple for every row of docs, after its doc_id; then the extra columns as x0, x1, ..."""
    rows = _identified(docs, extra)
    kinds = "".join(f", {c} {t}" for c, t in rows.dtypes[3:])
    plain = rows.select("doc", "h", "text")
    made: list[str] = []
    found = materialize(referred(plain, window, bits, made), "factors")
    discard(docs.sparkSession, made)
    quotes = materialize(quoted(plain, found, made), "quotes")
    discard(docs.sparkSession, made)
    wanted = KeyFilter.of(quotes, "h")
    own = f"doc_id long, {schema}"
    names = [c.split()[0] for c in own.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in own.split(", ")]
    others = [c for c, _ in rows.dtypes[3:]]

    def rendered(batch, raws, found, first):
        docs_ = batch.column(0).to_pylist()
        out = [(None if d == NO_KEY else d, *render(raw, s)) for d, raw, s in zip(docs_, raws, found, strict=True)]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)]
        return pa.record_batch([*columns, *(batch.column(first + i) for i in range(len(others)))], names=[*names, *others])

    @lean
    def unique(batches):
        """Documents without a factor stay where they are."""
        for batch in sliced(batches, 500):
            batch = batch.filter(pa.array(~wanted.may_have(np.asarray(batch.column(1)))))
            yield rendered(batch, [_encoded(t) for t in batch.column(2).to_pylist()], [[]] * batch.num_rows, 3)

    @lean
    def sent(batches):
        yield from _packed(b.filter(pa.array(wanted.may_have(np.asarray(b.column(1))))) for b in sliced(batches, 500))

    @lean
    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in sliced(batches, 500):
            raws = [opened.decompress(z) if z else b"" for z in batch.column(2).to_pylist()]
            found = []
            for raw, quotes_ in zip(raws, batch.column(3).to_pylist(), strict=True):
                found.append(spans(raw.split(), unquoted(quotes_, opened), window) if quotes_ else [])
            yield rendered(batch, raws, found, 4)

    joined = rows.mapInArrow(sent, "doc long, h long, z binary" + kinds).join(quotes, ["doc", "h"], "left").select("doc", "h", "z", "quotes", *others)
    return rows.mapInArrow(unique, own + kinds).unionByName(joined.mapInArrow(run, own + kinds))


def _digest_of(raw: bytes, found) -> tuple[int, int, str]:
    words = raw.split()
    kept, at = [], 0
    for a, b in found:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _text_of(raw: bytes, found) -> tuple[str, int]:
    """The text without the spans; what stays is unchanged but for white space where a span was."""
    text = raw.decode("utf-8", "surrogatepass")
    if not found:
        return text, len(text)
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for a, b in found:
        kept.append(text[at : places[a][0]].strip())
        at = places[b - 1][1]
    kept.append(text[at:].strip())
    text = "\n".join(k for k in kept if k)
    return text, len(text)


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every duplicate span cut out of text and n_chars set; other columns as they are. Null texts become empty."""
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = parsed(docs, _text_of, "text string, n_chars long", window, extra)
    columns = {"doc_id": "doc_id", "text": "text", "n_chars": "n_chars"} | {c: f"x{i}" for i, c in enumerate(extra)}
    return out.select(*(F.col(columns[c]).alias(c) for c in docs.columns))


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return parsed(docs, _digest_of, "n_words long, n_removed long, kept_sha256 string")
