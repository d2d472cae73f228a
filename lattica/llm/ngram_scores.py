"""Stupid-backoff language-model scores of every document under counts of the whole corpus.

The model is a bigram model over all words, each by its own count; words are white-space
separated, lower case. Only where a caller names most_words is it one over the most frequent
words (whole ties only, so never more) and one class for all others.
A word scores c(v w) / c(v) where the pair occurs in another place of the corpus than the
document that is scored, else it backs off to 0.4 c(w) / N; the first word of a document scores
c(w) / N. (A document's own pairs are always in the counts, so without that no document would
ever back off.) All counts are of the whole corpus, none is cut. A document's score is the sum
of logs; how many of its words backed off is told beside it.

At most VOCABULARY frequent words have short numbers, for packing; the others go by 64-bit
hashes, which changes no result. Documents are read in chunks of some CHUNK_WORDS words. A chunk
counts its own pairs and its words without a number, and sends each once, with how often it has
it, to the bucket that the key's hash names; a bucket adds up what all chunks have of a key, and
answers each chunk with the totals in the order in which the chunk sent its keys. The chunk's
documents, as numbers of words, meet the answers and are scored. So what is shuffled is a few
bytes a different pair of a chunk, however many buckets there are, and no key, however frequent,
is in a bucket more than once a chunk. A pair with a word without a number lies in the
bucket of that word (of the first, if both are) beside it.
There is a bucket for every WORDS_A_BUCKET words of the corpus, so a bucket's size stays the
same; a task holds one bucket or one chunk at a time.

Null and empty texts have no words, score 0 and no mean. Every row is scored by itself,
repeated rows and null ids too. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, sliced, table

VOCABULARY = 65_535
HOT = 256  # of no effect: frequent pairs are sent once a chunk like any other
BACKOFF = 0.4
WORDS_A_BUCKET = 2_000_000
CHUNK_WORDS = 1_000_000
COUNTED = 300_000  # different words that a task counts before it sends them
CACHE = 400_000
SCALE = 16


def _hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - ((h >> 63) << 64)


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (its hash), n over all documents; counted in each task before the shuffle."""

    def counted(seen):
        return pa.record_batch([pa.array([_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    @lean
    def run(batches):
        seen: Counter[str] = Counter()
        for batch in sliced(batches, 100):
            for text in batch.column(0).to_pylist():
                seen.update(_words(text))
            if len(seen) > COUNTED:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes by falling count, their counts, all words): at most `most` words, whole ties only."""
    steps = F.floor(F.log2("n") * SCALE).cast("int")
    sizes = {r["s"]: (r["k"], r["n"]) for r in counts.groupBy(steps.alias("s")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    total, taken, edge = sum(n for _, n in sizes.values()), 0, None
    for s in sorted(sizes, reverse=True):
        if taken + sizes[s][0] > most:
            break
        taken, edge = taken + sizes[s][0], s
    if edge is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), total
    rows = counts.where(steps >= edge).collect()
    hashes, ns = np.array([r["word"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    order = np.lexsort((hashes, -ns))
    return hashes[order], ns[order], total


def _rare(h: int) -> int:
    """The hash of a word without a number as an unsigned long beyond all numbers."""
    return max(h & (1 << 64) - 1, VOCABULARY + 1)


class _Ids:
    """Numbers of words: 1 for the most frequent; for those outside the vocabulary 0, or if whole their hashes."""

    class Known(dict):
        def __init__(self, ranks: dict[int, int], whole: bool):
            self.ranks, self.whole = ranks, whole

        def __missing__(self, word: str) -> int:
            h = _hash(word)
            self[word] = now = self.ranks.get(h) or (_rare(h) if self.whole else 0)
            return now

    def __init__(self, hashes: np.ndarray, whole: bool = False):
        self.known = self.Known({h: i + 1 for i, h in enumerate(hashes.tolist())}, whole)

    def of(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        words = _words(text)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def _packed(*arrays: np.ndarray) -> bytes:
    """The arrays, byte by byte: all first bytes, all second ones and so on, as most high bytes are zero."""
    lens = np.array([len(a) for a in arrays], "<u4")
    return zstandard.compress(b"".join([lens.tobytes(), *(np.ascontiguousarray(a).view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays)]), 3)


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(raw)
    lens, at, out = np.frombuffer(data[: 4 * len(kinds)], "<u4").tolist(), 4 * len(kinds), []
    for n, kind in zip(lens, kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, "u1", n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of a sorted array; np.cumsum turns them back."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


#: What data holds: a chunk's documents, the keys a chunk sends to a bucket, a bucket's answer to them.
HEAD, KEYS, TOTALS = 2, 1, 0
PACKED = "bucket int, chunk long, kind int, data binary"
NAMES, TYPES = ["bucket", "chunk", "kind", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
HEADS = ("<i8", "<u1", "<u4", "<u2", "<u8", "<u4")  # ids, whether there, words each; numbers (0 for words without), their hashes, which hash each has
SENT = ("<u4", "<u4", "<u8", "<u4", "<u4", "<u8", "<u4")  # pairs of numbers, times; words, times; pairs: word * 2 + whether it is first, other word, times


def _batch(rows: list[tuple]):
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, TYPES, strict=True)], names=NAMES)


class Scores:
    """Log scores of pairs, given their counts."""

    def __init__(self, counts: np.ndarray, total: int):
        own = np.r_[max(0, total - int(counts.sum())), counts]
        self.log = np.log(np.maximum(own, 1))
        self.total = np.log(max(total, 1))

    def first(self, w):
        return self.log[w] - self.total

    def pair(self, v, w, n, elsewhere):
        return np.where(elsewhere, np.log(np.maximum(n, 1)) - self.log[v], np.log(BACKOFF) + self.log[w] - self.total)


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for a in ordered:
        new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[starts, n])


def _added(ns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(ns, starts) if len(starts) else np.zeros(0, np.int64)


#: Odd factors: keys are ordered by their product, which a bucket is a range of.
SPREAD, SPREAD_LONG = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


class _Keys:
    """The different pairs and words without a number of a chunk, in the order of their buckets, and which of its documents have which pair how often."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray):
        owner = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
        same = owner[:-1] == owner[1:]
        o, a, b = owner[:-1][same], flat[:-1][same], flat[1:][same]
        short = (a <= VOCABULARY) & (b <= VOCABULARY)
        # pairs of numbers: of each (pair, document) the times, and the pair's place among all
        each = np.sort(((a[short] << np.uint64(16) | b[short]) * SPREAD & LOW) << np.uint64(32) | o[short])
        starts = _starts(each)
        each, self.n = each[starts], _lengths(starts, len(each))
        pair, self.doc = each >> np.uint64(32), (each & LOW).astype(np.int64)
        starts = _starts(pair)
        self.pairs, self.pair_n = pair[starts], _added(self.n, starts)
        self.at = np.repeat(np.arange(len(starts)), _lengths(starts, len(pair)))
        # words without a number, and the pairs they are in
        self.words, self.word_n = np.unique(flat[flat > VOCABULARY] * SPREAD_LONG, return_counts=True)
        o, a, b = o[~short], a[~short], b[~short]
        first = a > VOCABULARY
        own = self.place(np.where(first, a, b)) * 2 + first
        other = np.where(first, b, a)
        order = np.lexsort((o, other, own))
        o, own, other = o[order], own[order], other[order]
        starts = _starts(own, other, o)
        own, other, self.long_doc, self.long_n = own[starts], other[starts], o[starts].astype(np.int64), _lengths(starts, len(o))
        starts = _starts(own, other)
        self.own, self.other, self.own_n = own[starts], other[starts], _added(self.long_n, starts)
        self.long_at = np.repeat(np.arange(len(starts)), _lengths(starts, len(own)))

    def place(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, words * SPREAD_LONG)

    def dealt(self, buckets: int):
        """(bucket, its keys packed) for every bucket that has some."""
        spot = lambda high: (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = lambda places: np.searchsorted(places, np.arange(buckets + 1))
        word = spot(self.words >> np.uint64(32))
        pairs, words, longs = cut(spot(self.pairs)), cut(word), cut(word[self.own >> 1])
        for p in np.flatnonzero((np.diff(pairs) > 0) | (np.diff(words) > 0)).tolist():
            i, j, k = (slice(x[p], x[p + 1]) for x in (pairs, words, longs))
            arrays = _steps(self.pairs[i]), self.pair_n[i], _steps(self.words[j]), self.word_n[j], _steps(self.own[k] - 2 * words[p]), self.other[k], self.own_n[k]
            yield p, _packed(*(x.astype(t) for x, t in zip(arrays, SENT, strict=True)))


def _exploded(hashes, buckets, whole):
    @lean
    def run(batches):
        ids, task = _Ids(hashes, whole), TaskContext.get().partitionId()
        spot = task << 32

        def chunk(number, docs, xs):
            doc = pa.chunked_array(docs, pa.int64())
            lens, flat = np.array([len(x) for x in xs], "<u4"), np.concatenate(xs)
            rare = flat > VOCABULARY
            words, which = np.unique(flat[rare], return_inverse=True)
            head = _packed(doc.fill_null(0).to_numpy().astype("<i8"), doc.is_valid().to_numpy().astype("<u1"), lens, np.where(rare, 0, flat).astype("<u2"), _steps(words), which.astype("<u4"))
            return _batch([((task + number) % buckets, spot + number, HEAD, head), *((p, spot + number, KEYS, data) for p, data in _Keys(flat, lens).dealt(buckets))])

        number, docs, xs, size = 0, [], [], 0
        for batch in sliced(batches, 100):
            docs.append(batch.column(0))
            for text in batch.column(1).to_pylist():
                xs.append(ids.of(text))
                size += len(xs[-1])
            if size >= CHUNK_WORDS:
                yield chunk(number, docs, xs)
                number, docs, xs, size = number + 1, [], [], 0
        if xs:
            yield chunk(number, docs, xs)

    return run


def _totalled(held):
    """What all chunks have of each key of a bucket: an answer to each (chunk, keys)."""
    parts = [_unpacked(data, *SENT) for _, data in held]
    sizes = [[len(x) for x in part] for part in parts]

    def summed(which, ns):
        return np.bincount(which, ns).astype(np.int64)[which] if len(which) else np.zeros(0, np.int64)

    def joined(i, steps=False, kind=None):
        return np.concatenate([np.cumsum(p[i], dtype=kind or p[i].dtype) if steps else p[i] for p in parts])

    pair = summed(np.unique(joined(0, True), return_inverse=True)[1], joined(1))
    which = np.unique(joined(2, True), return_inverse=True)[1]
    word = summed(which, joined(3))
    before = np.repeat(np.cumsum([0, *(s[2] for s in sizes)])[:-1], [s[4] for s in sizes])
    own = joined(4, True, np.int64)
    own = (which[before + (own >> 1)] * 2 + (own & 1)) if len(own) else own
    other, ns = joined(5), joined(6).astype(np.int64)
    order = np.lexsort((other, own))
    starts = _starts(own[order], other[order])
    long = np.zeros(len(own), np.int64)
    long[order] = np.repeat(_added(ns[order], starts), _lengths(starts, len(own)))
    at = [0, 0, 0]
    for (chunk, _), size in zip(held, sizes, strict=True):
        ends = [x + size[i] for x, i in zip(at, (0, 2, 4), strict=True)]
        yield chunk, _packed(*(x[a:b].astype("<u8") for x, a, b in zip((pair, word, long), at, ends, strict=True)))
        at = ends


@lean
def _answered(batches):
    """Rows sorted by bucket: heads pass, keys become totals."""
    bucket, held = None, []
    for batch in batches:
        rows = []
        for b, chunk, kind, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if b != bucket and held:
                rows += [(bucket, c, TOTALS, x) for c, x in _totalled(held)]
                held = []
            bucket = b
            if kind == HEAD:
                rows.append((b, chunk, kind, data))
            else:
                held.append((chunk, data))
        yield _batch(rows)
    if held:
        yield _batch([(bucket, c, TOTALS, x) for c, x in _totalled(held)])


def _scored(counts, total):
    """Rows sorted by chunk, its head first, its totals by bucket."""
    scores = Scores(counts, total)

    def flush(head, answers):
        doc, known, lens, numbers, words, which = _unpacked(head, *HEADS)
        flat = numbers.astype(np.uint64)
        flat[flat == 0] = np.cumsum(words)[which] if len(words) else 0
        keys, n_docs = _Keys(flat, lens), len(lens)
        totals = [_unpacked(x, "<u8", "<u8", "<u8") for x in answers]
        pair, word, long = (np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in totals)]).astype(np.int64) for i in range(3))
        inverse = np.uint64(pow(int(SPREAD), -1, 1 << 32))
        both = (keys.pairs * inverse & LOW).astype(np.int64)[keys.at]
        often = pair[keys.at] > keys.n
        sums = np.zeros(n_docs)
        sums += np.bincount(keys.doc, scores.pair(both >> 16, both & 0xFFFF, pair[keys.at], often) * keys.n, n_docs)
        backs = np.bincount(keys.doc, keys.n * ~often, n_docs).astype(np.int64)

        def log(w):
            rare = w > VOCABULARY
            out = scores.log[np.where(rare, 0, w).astype(np.int64)]
            out[rare] = np.log(word[keys.place(w[rare])])
            return out

        mine, first = np.log(word)[keys.own >> 1], (keys.own & 1) == 1
        other = log(keys.other)
        v, w = np.where(first, mine, other)[keys.long_at], np.where(first, other, mine)[keys.long_at]
        often = long[keys.long_at] > keys.long_n
        sums += np.bincount(keys.long_doc, np.where(often, np.log(long)[keys.long_at] - v, np.log(BACKOFF) + w - scores.total) * keys.long_n, n_docs)
        backs += np.bincount(keys.long_doc, keys.long_n * ~often, n_docs).astype(np.int64)
        some = lens > 0
        sums[some] += log(flat[(np.cumsum(lens, dtype=np.int64) - lens)[some]]) - scores.total
        mean = pa.array(np.divide(sums, lens, out=np.zeros(n_docs), where=some), mask=~some)
        return pa.record_batch([pa.array(doc, mask=known == 0), pa.array(lens.astype(np.int64)), pa.array(sums), mean, pa.array(backs.astype(np.int64))], names=["doc_id", "n_words", "log_score", "mean_log_score", "n_backed_off"])

    @lean
    def run(batches):
        head, answers = None, []
        for batch in batches:
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind == HEAD:
                    if head is not None:
                        yield flush(head, answers)
                    head, answers = data, []
                else:
                    answers.append(data)
        if head is not None:
            yield flush(head, answers)

    return run


def stupid_backoff(docs: DataFrame, most_words: int | None = None) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_backed_off of every row of docs(doc_id, text); with most_words one class for all words beyond the most frequent."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, whole, made = docs.sparkSession, most_words is None, []
    hashes, counts, total = vocabulary(materialize(word_counts(rows.select("text")), "words", made), VOCABULARY if whole else most_words)
    discard(spark, made)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // WORDS_A_BUCKET))
    totals = rows.mapInArrow(_exploded(hashes, buckets, whole), PACKED).repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_answered, PACKED)
    back = totals.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"), "bucket")
    return back.mapInArrow(_scored(counts, total), "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long")


def op7_ngram_scores(spark, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))
