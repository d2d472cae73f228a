"""Benchmark decontamination by latent semantic retrieval and a longest-common-subsequence check.

Words are lower case without outer punctuation, hashed to TERMS buckets; a window's term
frequencies count by their roots; idf is over all
documents in passages of PASSAGE words. The latent space is the leading right singular
vectors of TF-IDF passages, by randomised subspace iteration: each round multiplies a dense
block by the passages where they lie, and the products are added where Spark deals them. The basis is
fitted on every passage of the benchmark, none left out, and the idf on every passage of the corpus:
nothing comes from a sample. It is the benchmark that the latent space has to hold, as only the
share of a query in it bounds what can be found. The index is every window of every document.

A benchmark item is cut into query passages as long as the windows of its class. A window is
a candidate of an item where the inner product of their latent vectors, over the window's
length and the latent length of the query, reaches COSINE. Windows that can't are skipped by
an exact bound: the sum of what each word could add for any query.

The latent space is fixed in size, so of a large benchmark it holds many passages in part only.
Where the latent share |Pq| / |q| of any passage of an item is below SHARE, or the item is
shorter than a window, the item is searched exactly instead: its rarer words are joined to the
words of overlapping blocks of each document, and wherever enough of them meet for the subsequence
that a leak needs, every stretch as long as the item and its margins is checked. No leaked
stretch is missed there, whatever the size of the benchmark; the cosine given is that of
TF-IDF of the item and the stretch.

For a candidate the item
is compared with the words around the window: it is leaked if their longest common
subsequence covers COPY of the item, or PARAPHRASE of it and ANSWER of its answer, the last
fifth of its words.

Query passages are taken in blocks of QUERIES, one pass over the documents a block, so a
benchmark of any size is served with tables of bounded size. Null and empty texts, and items
without words, leak nothing. Repeated rows are searched each. Items of fewer than four words
are looked for as they are: all words, in order, one after the other.
"""

from __future__ import annotations

import functools
import re
import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TABULATED, keyed, lean, materialize, release, runs_of, sliced, table, tabulated

TERMS = 1 << 14
DIMENSIONS, SPARE, ROUNDS = 256, 16, 2
PASSAGE = 32
FIT_ITEMS, FIT_TASKS = 20_000, 4  # items a task, and tasks at least: each sends a dense block
QUERIES = 2_048
CLASSES = ((16, 4), (32, 8))  # window and stride, in words
COSINE = 0.6
#: A window of TF-IDF cosine c to a query of latent share s scores (c - sqrt(1 - s * s)) / s at least: c of 0.79 is safe.
SHARE = 0.98
COPY, PARAPHRASE, ANSWER = 0.75, 0.6, 0.6
ROW_BLOCK = 256
CACHE = 300_000
LONG = 2_000_000  # characters of the longest text whose words are cut at once
STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def _bare(word: str) -> str:
    if word.isalnum():
        return word
    most = word[:-1]
    return most if most.isalnum() else STRIP.sub("", word)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        bare = _bare(word)
        self[word] = now = crc32(bare.encode("utf-8", "surrogatepass")) % TERMS if bare else TERMS
        return now


@functools.cache
def _characters(most: int) -> np.ndarray:
    """0 for white space, 2 for letters and digits, 1 for all others of the first characters, as str has it."""
    return np.array([0 if (x := chr(c)).isspace() else 1 + x.isalnum() for c in range(most)], np.uint8)


@functools.cache
def _checksums() -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to the crc32 of a word by its distance to the end, and the crc32 of as many zeros: it is linear but for the length."""
    zeros = np.array([crc32(bytes(n)) for n in range(TABULATED + 1)], np.uint32)
    return np.array([[crc32(bytes([b]) + bytes(d)) for b in range(256)] for d in range(TABULATED)], np.uint32) ^ zeros[1:, None], zeros


class _Terms:
    """Buckets of the words of a text; TERMS for words without letters or digits."""

    def __init__(self):
        self.known, self.ahead = _Buckets(), {}

    def of(self, text: str | None) -> np.ndarray:
        if text in self.ahead:
            return self.ahead[text]
        if len(self.known) > CACHE:
            self.known.clear()
        words = (text or "").lower().split()
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def each(self, texts: list) -> list[np.ndarray]:
        """of(text) of every text, the words of all texts at once; only texts over LONG are cut one by one."""
        plain: tuple[dict, dict] = ({}, {})
        for t in texts:
            if t and len(t) <= LONG:
                plain[t.isascii()][t] = None
        for same in plain:
            for few in _few(list(same)):
                self.ahead.update(zip(few, self._cut([t.lower() for t in few]), strict=True))
        found = [self.of(t) for t in texts]
        self.ahead.clear()
        return found

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        text = "\n".join(texts)
        packed = text.encode("utf-8", "surrogatepass")
        raw, at = np.frombuffer(packed, np.uint8), None
        if len(packed) == len(text):
            kinds = np.frombuffer(packed.translate(_characters(256).tobytes()), np.uint8)
        else:
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = _characters(1 << 16 if chars.max() < 1 << 16 else sys.maxunicode + 1).take(chars)
            at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # where each character begins
        starts, ends = runs_of(kinds > 0)
        first, last = starts.copy(), ends.copy()
        # words that don't begin and end with a letter or digit, from their first to their last one
        letters, odd = np.flatnonzero(kinds > 1), np.flatnonzero((kinds[starts] < 2) | (kinds[ends - 1] < 2))
        low, high = np.searchsorted(letters, starts[odd]), np.searchsorted(letters, ends[odd])
        there = high > low
        first[odd[there]], last[odd[there]] = letters[low[there]], letters[high[there] - 1] + 1
        last[odd[~there]] = first[odd[~there]]
        if at is not None:
            first, last = at[first], at[last]
        tables, zeros = _checksums()
        sizes, out = last - first, np.full(len(starts), TERMS, np.int32)
        usual = np.flatnonzero((sizes > 0) & (sizes <= TABULATED))
        out[usual] = (tabulated(raw, last[usual], sizes[usual], tables) ^ zeros[sizes[usual]]) % TERMS
        for i in np.flatnonzero(sizes > TABULATED).tolist():
            out[i] = crc32(raw[first[i] : last[i]]) % TERMS
        return np.split(out, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def _sum_blocks(parts: DataFrame, shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
    """Adds up rows (block int, data binary), each a block of ROW_BLOCK rows of an array of the shape.

    They are added where Spark deals them by block; the driver takes the sums a few blocks at a time.
    """

    @lean
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(data, kind)
                sums[block] = sums[block] + now if block in sums else now
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "data"])

    out = np.zeros(shape, kind)
    for r in parts.repartition(32, "block").mapInArrow(add, "block int, data binary").toLocalIterator():
        at = r["block"] * ROW_BLOCK
        rows = out[at : at + ROW_BLOCK]
        rows += np.frombuffer(bytes(r["data"]), kind).reshape(rows.shape)
    return out


def _emit(array: np.ndarray, kind: type = np.float64):
    at = range(0, len(array), ROW_BLOCK)
    return pa.record_batch([pa.array([k // ROW_BLOCK for k in at], pa.int32()), pa.array([array[k : k + ROW_BLOCK].astype(kind).tobytes() for k in at], pa.binary())], names=["block", "data"])


def _few(texts: list, most: int = 500_000):
    """texts in runs of about most characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log of passages over passages with the term, of every term; 0 for TERMS."""

    @lean
    def run(batches):
        terms, counts = _Terms(), np.zeros(TERMS + 1, np.float64)
        for batch in sliced(batches):
            for few in _few(batch.column(0).to_pylist()):
                each = terms.each(few)
                sizes = np.array([len(x) for x in each])
                ids, starts = np.concatenate(each).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]]
                used = -(-sizes // PASSAGE)
                own = (np.arange(len(ids)) - np.repeat(starts, sizes)) // PASSAGE + np.repeat(np.r_[0, np.cumsum(used)[:-1]], sizes)
                pairs = np.sort(own * (TERMS + 1) + ids)
                pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
                now = np.bincount(pairs % (TERMS + 1), minlength=TERMS + 1)
                now[TERMS] = used.sum()
                counts += now
        yield _emit(counts)  # the last is the number of passages

    counts = _sum_blocks(texts.mapInArrow(run, "block int, data binary"), (TERMS + 1,))
    idf = np.log((counts[TERMS] + 1) / (counts + 1))
    idf[TERMS] = 0
    return np.maximum(idf, 0).astype(np.float32)


def passages(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of consecutive pieces of size words, the last ending with the text."""
    if len(ids) <= size:
        return [(0, ids)] if len(ids) else []
    starts = [*range(0, len(ids) - size, size), len(ids) - size]
    return [(s, ids[s : s + size]) for s in starts]


def query_passages(ids: np.ndarray) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """(class, passages) of an item, words without letters or digits left out."""
    ids = ids[ids != TERMS]
    kind = 0 if len(ids) < 2 * CLASSES[0][0] else 1
    return kind, passages(ids, CLASSES[kind][0])


def _fit_rows(benchmark: DataFrame) -> DataFrame:
    """ids: the passages that the basis is fitted on, all of the benchmark's."""

    def run(batches):
        terms = _Terms()
        for batch in batches:
            found = [p for t in batch.column(0).to_pylist() for _, p in query_passages(terms.of(t))[1]]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32()))], names=["ids"])

    tasks = max(FIT_TASKS, -(-benchmark.count() // FIT_ITEMS))
    return benchmark.select("text").mapInArrow(run, "ids array<int>").repartition(tasks, F.xxhash64("ids"))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """The left singular vectors of x, greatest first, in place and a slice at a time; directions that x lacks are zero."""
    for again in (False, True):  # the second time for precision, without turning them
        gram = np.zeros((x.shape[1], x.shape[1]))
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float64)
            gram += part.T @ part
        values, turn = np.linalg.eigh(gram)
        there = values > 1e-10 * max(values.max(), 1e-30)
        scale = np.where(there, 1 / np.sqrt(np.where(there, values, 1)), 0)
        turn = (turn * scale) @ turn.T if again else (turn * scale)[:, ::-1]
        for at in range(0, len(x), 1024):
            x[at : at + 1024] = x[at : at + 1024].astype(np.float64) @ turn
    return x


def basis(rows: DataFrame, idf: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """(TERMS + 1, dimensions): orthonormal leading right singular vectors of the TF-IDF rows, the last row zero."""
    width = max(1, min(dimensions + SPARE, rows.count()))
    block = _orthonormal(np.random.default_rng(7).standard_normal((TERMS, width), np.float32))
    for _ in range(ROUNDS):
        dense = np.zeros((TERMS + 1, width), np.float32)
        dense[:TERMS] = block
        del block
        sent = rows.sparkSession.sparkContext.broadcast(dense)

        @lean
        def run(batches, sent=sent):
            now, out = sent.value, np.zeros((TERMS + 1, width), np.float32)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    few = batch.slice(at, 256)
                    sizes = np.array([len(x) for x in few.column(0)])
                    own, row = few.column(0).flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                    length = np.sqrt(np.maximum(np.bincount(row, idf[own].astype(float) ** 2, len(sizes)), 1e-18))
                    value = (idf[own] / length[row]).astype(np.float32)
                    sums = np.add.reduceat(value[:, None] * now[own], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
                    order = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
                    out[own[order][first]] += np.add.reduceat((value[:, None] * sums[row])[order], first, axis=0)
            yield _emit(out[:TERMS], np.float32)

        block = _sum_blocks(rows.select("ids").mapInArrow(run, "block int, data binary"), (TERMS, width), np.float32)
        sent.destroy()
        del dense, sent, run
        block = _orthonormal(block)  # the leading directions first
        release()
    return np.vstack([block[:, :dimensions], np.zeros((1, min(dimensions, width)), np.float32)])


def _words(text: str | None) -> list[str]:
    return [b for w in (text or "").lower().split() if (b := _bare(w))]


def common_subsequence(a: list[str], b: list[str]) -> tuple[int, int]:
    """(length of the longest common subsequence, of the part of it that the last fifth of a has), bit-parallel over a."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    answer = full & ~((1 << (len(a) - max(1, len(a) // 5))) - 1)
    return (full & ~row).bit_count(), (answer & ~row).bit_count()


def leaked(item: list[str], around: list[str]) -> tuple[bool, float, float]:
    n = len(item)
    length, answer = common_subsequence(item, around)
    share, own = length / n, answer / max(1, n // 5)
    return share >= COPY or share >= PARAPHRASE and own >= ANSWER, share, own


def _needed(n: int) -> int:
    """Words in common without which no item of n words is leaked."""
    return n if n < 4 else next(k for k in range(1, n + 1) if k / n >= PARAPHRASE)


def _margin(n: int) -> int:
    return 0 if n < 4 else max(4, n // 4)


class _Exact:
    """Leaked stretches of the words of a text, for items(number, words), without a latent space."""

    def __init__(self, items, idf):
        self.terms, self.idf = _Terms(), idf.astype(np.float64)
        classes: dict[int, list] = {}
        for i, words in items:
            classes.setdefault(len(words).bit_length(), []).append((i, words))
        self.groups = [self._group(own) for own in classes.values()]

    def _group(self, own):
        reach = max(len(w) + 2 * _margin(len(w)) for _, w in own)
        of, which, least = [], [], []
        for k, (_, words) in enumerate(own):
            need = _needed(len(words))
            ids = self.terms.of(" ".join(words))
            # the need // 2 most common words can't make up a leak by themselves: the others have the rest
            ids = ids[np.argsort(-self.idf[ids], kind="stable")][: len(ids) - need // 2]
            of.append(ids), which.append(np.full(len(ids), k)), least.append(need - need // 2)
        key, times = np.unique(np.concatenate(of).astype(np.int64) * len(own) + np.concatenate(which), return_counts=True)
        first = np.searchsorted(key // len(own), np.arange(TERMS + 2))
        return own, reach, first, key % len(own), times, np.array(least)

    def candidates(self, each):
        """(text's number, item's number, words, first and last word of a block) where enough words meet."""
        each = [ids[ids != TERMS] for ids in each]
        sizes = np.array([len(x) for x in each])
        ids, begin = np.concatenate(each), np.r_[0, np.cumsum(sizes)]
        for own, reach, first, items, times, least in self.groups:
            # blocks of twice the reach, one every reach: any stretch lies whole in one
            steps = np.where(sizes > 0, np.maximum(-(-sizes // reach) - 1, 1), 0)
            total, block0 = int(steps.sum()), np.r_[0, np.cumsum(steps)[:-1]]
            doc = np.repeat(np.arange(len(sizes)), steps)
            starts = (np.arange(total) - np.repeat(block0, steps)) * reach
            spot = np.flatnonzero(first[ids + 1] > first[ids])
            if not len(spot):
                continue
            d = np.searchsorted(begin, spot, side="right") - 1
            last = (spot - begin[d]) // reach
            now, before = block0[d] + np.minimum(last, steps[d] - 1), block0[d] + last - 1
            two = (last > 0) & (before != now)
            keys = np.sort(np.r_[now, before[two]] * (TERMS + 1) + np.r_[ids[spot], ids[spot[two]]])
            keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
            blocks, terms = keys // (TERMS + 1), keys % (TERMS + 1)
            most = max(1, 2_000_000 // len(own))
            counts = first[terms + 1] - first[terms]
            ends = np.cumsum(counts)
            at = 0
            while at < len(keys):
                # whole blocks: as many as keep postings and sums bounded, one at least
                to = min(np.searchsorted(ends, ends[at] + 2_000_000, side="right"), np.searchsorted(blocks, blocks[at] + most))
                to = np.searchsorted(blocks, blocks[to]) if to < len(keys) else to
                if to <= at:
                    to = np.searchsorted(blocks, blocks[at], side="right")
                n = counts[at:to]
                places = np.repeat(first[terms[at:to]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                rows = np.repeat(blocks[at:to] - blocks[at], n)
                sums = np.bincount(rows * len(own) + items[places], times[places]).astype(np.int64)
                for hit in np.flatnonzero(sums >= np.resize(least, len(sums))).tolist():
                    b, k = int(blocks[at]) + hit // len(own), hit % len(own)
                    yield int(doc[b]), *own[k], int(starts[b]), int(starts[b]) + 2 * reach
                at = to

    def cosine(self, a: list[str], b: list[str]) -> float:
        both = []
        for words in (a, b):
            ids, n = np.unique(self.terms.of(" ".join(words)), return_counts=True)
            both.append(dict(zip(ids.tolist(), (np.sqrt(n) * self.idf[ids]).tolist(), strict=True)))
        x, y = both
        length = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return float(sum(v * y.get(t, 0.0) for t, v in x.items()) / length) if length else 0.0

    def leak(self, item: list[str], block: list[str]):
        """(cosine, common, answer, True) of the first leaked stretch of the block, or None."""
        n = len(item)
        size = n + 2 * _margin(n)
        if common_subsequence(item, block)[0] < _needed(n):
            return None
        for s in range(max(1, len(block) - size + 1)):
            around = block[s : s + size]
            is_leak, share, own = leaked(item, around)
            if is_leak and (n >= 4 or around == item):
                # the leak begins where it can't begin later
                while s + 1 < len(block) and (after := leaked(item, block[s + 1 : s + 1 + size]))[0] and n >= 4 and after[1:] >= (share, own):
                    s, (_, share, own) = s + 1, after
                return self.cosine(item, block[s : s + size]), share, own, True
        return None


OUT = "doc_id long, h long, item_id long, cosine double, common double, answer double, leaked boolean"


class _Search:
    """Candidate windows of a batch of texts for one block of query passages."""

    def __init__(self, idf, vectors, queries):
        # queries: (class, item, start in the item, latent vector of length 1)
        self.weighted = vectors * idf[:, None]
        self.classes = []
        for k, (size, stride) in enumerate(CLASSES):
            own = [q for q in queries if q[0] == k]
            if own:
                matrix = np.array([q[3] for q in own], np.float32)
                most = np.concatenate([(self.weighted[i : i + 4096] @ matrix.T).max(axis=1) for i in range(0, len(vectors), 4096)])
                self.classes.append((size, stride, own, matrix, np.maximum(most, 0).astype(np.float64)))
        self.square = idf.astype(np.float64) ** 2

    def candidates(self, each):
        """(text's number, query, first word, cosine) over the words' buckets of a few texts."""
        sizes = np.array([len(x) for x in each])
        ids, begin = np.concatenate(each), np.r_[0, np.cumsum(sizes)]
        norms = np.r_[0, np.cumsum(self.square[ids])]
        for size, stride, own, matrix, most in self.classes:
            # windows of each text: every stride, and the last one that fits
            steps = np.maximum(sizes - size, 0) // stride + 1
            steps[sizes == 0] = 0
            doc = np.repeat(np.arange(len(sizes)), steps)
            starts = (np.arange(steps.sum()) - np.repeat(np.r_[0, np.cumsum(steps)[:-1]], steps)) * stride
            last = np.flatnonzero((sizes > size) & ((sizes - size) % stride != 0))
            doc, starts = np.r_[doc, last], np.r_[starts, sizes[last] - size]
            first = begin[doc] + starts
            ends = np.minimum(first + size, begin[doc + 1])
            bound = np.r_[0, np.cumsum(most[ids])]
            norm = np.sqrt(np.maximum(norms[ends] - norms[first], 1e-9))
            able = np.flatnonzero(bound[ends] - bound[first] >= COSINE * norm)
            for at in np.array_split(able, max(1, len(able) // 256)):
                if not len(at):
                    continue
                places = first[at][:, None] + np.arange(size)
                inside = places < ends[at][:, None]
                own_ids = np.where(inside, ids[np.minimum(places, len(ids) - 1)], TERMS)
                # a term that occurs n times in a window weighs as the root of n: its occurrences as 1 / root each
                times = (own_ids[:, :, None] == own_ids[:, None, :]).sum(axis=2)
                sums = (self.weighted[own_ids] / np.sqrt(times, dtype=np.float32)[:, :, None]).sum(axis=1)
                score = (sums @ matrix.T) / norm[at, None].astype(np.float32)
                for i, q in zip(*np.nonzero(score >= COSINE), strict=True):
                    yield int(doc[at[i]]), own[q], int(starts[at[i]]), float(score[i, q])


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), item_id, cosine, common, answer of every (row of docs, leaked item of benchmark(item_id, text)).

    Each block of query passages is one pass over docs, written before the next begins, so
    neither the plan nor the driver grows with the benchmark.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    idf = inverse_frequencies(docs.select("text"))
    vectors = basis(materialize(_fit_rows(benchmark), "passages"), idf)
    tables = docs.sparkSession.sparkContext.broadcast((idf, vectors))  # (TERMS + 1) x (DIMENSIONS + 1) numbers
    rows, out = docs.select("doc_id", "text", F.xxhash64("text").alias("h")), None
    for items in _blocks(benchmark):
        now = materialize(rows.mapInArrow(_searched(items, tables), OUT).where("leaked").drop("leaked"), "found")
        out = now if out is None else out.union(now)
    tables.destroy()
    if out is None:
        return docs.sparkSession.createDataFrame([], OUT).drop("leaked")
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer of every (row of docs, leaked item of benchmark(item_id, text))."""
    return found(docs, benchmark).drop("h")


def latent_share(ids: np.ndarray, idf: np.ndarray, vectors: np.ndarray) -> float:
    """The part of the length of a passage's TF-IDF vector that the latent space holds."""
    own, n = np.unique(ids, return_counts=True)
    value = np.sqrt(n) * idf[own]
    length = float(np.linalg.norm(value))
    return float(np.linalg.norm(value @ vectors[own])) / length if length > 1e-9 else 0.0


def _blocks(benchmark: DataFrame):
    """The items in blocks of some QUERIES query passages; one block at a time is on the driver."""
    block, size = [], 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        n = len(_words(r["text"]))
        if not n:
            continue
        block.append((r["item_id"], r["text"]))
        size += n // CLASSES[0][0] + 1
        if size >= QUERIES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _searched(items, tables):
    @lean
    def run(batches):
        idf, vectors = tables.value
        terms, queries, cut, exact = _Terms(), [], [_words(t) for _, t in items], []
        for i, (_, text) in enumerate(items):
            kind, found = query_passages(terms.of(text))
            if len(cut[i]) < CLASSES[0][0] or min(latent_share(ids, idf, vectors) for _, ids in found) < SHARE:
                exact.append((i, cut[i]))
                continue
            for start, ids in found:
                vector = (vectors[ids] * idf[ids][:, None]).sum(axis=0)
                queries.append((kind, i, start, vector / float(np.linalg.norm(vector))))
        search, sparse = _Search(idf, vectors, queries), _Exact(exact, idf)
        for batch in sliced(batches):
            rows, ids, done = [], list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), 0
            for few in _few(batch.column(1).to_pylist()):
                best: dict[tuple[int, int], tuple] = {}
                words: dict[int, list[str]] = {}
                each = terms.each(few)
                for k, (_, i, start, _), at, cosine in search.candidates(each):
                    if (k, i) in best and best[k, i][-1]:
                        continue
                    if k not in words:
                        words[k] = (few[k] or "").lower().split()
                    n = len(cut[i])
                    pad = max(4, n // 4)
                    around = [b for w in words[k][max(0, at - start - pad) : at - start + n + pad] if (b := _bare(w))]
                    is_leak, share, own = leaked(cut[i], around)
                    if (k, i) not in best or (is_leak, share) > (best[k, i][-1], best[k, i][1]):
                        best[k, i] = (cosine, share, own, is_leak)
                if exact:
                    bare: dict[int, np.ndarray] = {}
                    for k, i, item, start, end in sparse.candidates(each):
                        if (k, i) in best:
                            continue
                        if k not in words:
                            words[k] = (few[k] or "").lower().split()
                        if k not in bare:
                            bare[k] = np.flatnonzero(each[k] != TERMS)
                        if (found := sparse.leak(item, [_bare(words[k][w]) for w in bare[k][start:end].tolist()])) is not None:
                            best[k, i] = found
                rows += [(*ids[done + k], items[i][0], *b) for (k, i), b in best.items()]
                done += len(few)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no benchmark item, all columns as they are. Of rows that share an id, or have none, each is judged by its own text."""
    gone = materialize(found(docs, benchmark).select(keyed().alias("doc"), "h").distinct(), "leaks")
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names may clash with ours
    own = docs.select(keyed().alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("h"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    return own.join(gone, ["doc", "h"], "left_anti").select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
