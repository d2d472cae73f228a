"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of the target (labelled good and not toxic) and
of raw text (every document), give each n-gram a log ratio and each document a log weight,
the sum of its ratios. N-grams are words, word beginnings and pairs of word shapes. Gumbel
noise on the log weights and a top-k make the resample; the noise is a hash of the id, so a
lost task draws the same again.

Rejection uses the same ratios: a logistic calibrator on their means, their low tail and
document length, fitted on labelled rows that the target model has not seen, with the
threshold where at most FALSE_REJECTS of the good ones go.

Every label is used: texts of the target are the only ones that are shuffled, and the calibrator
is fitted by sums over its rows where they lie. Raw counts cover every word of every document. Null and empty texts have weight zero and are kept or rejected as
the calibrator says of an empty document. Repeated labels of one document: it is good only
if all say so. Without labels of both kinds every document is kept and has weight zero.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, lean, materialize, sliced, table

#: Labelled rows used, those of least hash; None: all.
MOST_LABELLED = None
FALSE_REJECTS = 0.003
WORD_BITS, HEAD_BITS, HEAD, SHAPES = 18, 16, 4, 40
FROM = (0, 1 << WORD_BITS, (1 << WORD_BITS) + (1 << HEAD_BITS))  # where each family's buckets begin
BUCKETS = FROM[2] + SHAPES * SHAPES
BLOCK = 1024
PRIOR = 2.0
LOW = -1.5
STRIP = re.compile(r"^\W+|\W+$")
TAIL = re.compile(r"[\W_]*$")
CACHE = 150_000
#: ASCII characters that are no letter, digit or underscore, as STRIP and TAIL have them.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != "_")


class Features:
    """Bucket numbers of the n-grams of a text."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _code(self, word: str) -> int:
        if word.isascii():
            bare, tail = word.strip(MARKS), word[len(word.rstrip(MARKS + "_")) :]
        else:
            bare, tail = STRIP.sub("", word), TAIL.search(word)[0]
        low = bare.lower()
        head = low[:HEAD] if len(low) > HEAD else "^" + low
        kind = 0 if not bare else 1 if not bare.isalpha() and any(c.isdigit() for c in bare) else 2 if len(bare) > 1 and bare.isupper() else 3 if bare[:1].isupper() else 4
        end = 0 if not tail else 1 if len(tail) == 1 and tail in ".,;:?!" else 2 if len(tail) == 1 else 3
        h = crc32(low.encode("utf-8", "surrogatepass"))
        g = crc32(head.encode("utf-8", "surrogatepass"), 7)
        return ((h >> (32 - WORD_BITS)) << 32) | ((g >> (32 - HEAD_BITS)) << 8) | (kind * 4 + end)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = (text or "").split()
        try:
            codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.known) > CACHE:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            for w in words:
                if w not in known:
                    code = older.get(w)
                    known[w] = self._code(w) if code is None else code
            codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        word, head, shape = codes >> 32, (codes >> 8) & 0xFFFF, codes & 0xFF
        again = np.zeros(len(codes), np.int64)
        again[1:] = word[1:] == word[:-1]
        shape = shape * 2 + again
        pairs = shape[:-1] * SHAPES + shape[1:] if len(shape) else shape
        return word, head + FROM[1], pairs + FROM[2]


def _known(labels: DataFrame, most: int | None) -> DataFrame:
    """doc_id, role of every labelled document: 1 target model, 2 calibrator and good, 3 calibrator and bad."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.min("quality") > 0).alias("fine"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = known.select("doc_id", (F.col("fine") & (F.col("toxic") == 0)).alias("good"), F.xxhash64("doc_id", F.lit(4)).alias("draw"))
    if most is not None and (n := known.count()) > most:
        edge = known.select(F.percentile_approx("draw", most / n, 100_000)).first()[0]
        known = known.where(F.col("draw") <= edge)
    role = F.when(F.col("good") & (F.pmod("draw", F.lit(2)) == 0), 1).when(F.col("good"), 2).otherwise(3)
    return materialize(known.select("doc_id", role.alias("role")), "known")


def _marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the role of known(doc_id, role), a written table, else 0. Only texts that a filter of bounded size lets through are joined."""
    wanted = KeyFilter.of(known, "doc_id")

    def where(there: bool):
        @lean
        def run(batches):
            for batch in sliced(batches):
                found = wanted.may_have(np.asarray(batch.column(0).fill_null(0)))
                yield batch.filter(pa.array(found if there else ~found))

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain, some = (rows.mapInArrow(where(there), "doc_id long, text string") for there in (False, True))
    some = some.join(known, "doc_id", "left").select("doc_id", "text", F.coalesce("role", F.lit(0)).alias("role"))
    return plain.withColumn("role", F.lit(0)).unionByName(some)


def _roles(docs: DataFrame, labels: DataFrame, most: int | None) -> DataFrame:
    """docs(doc_id, text) with role: that of _known, 0 none."""
    return _marked(docs, _known(labels, most))


@lean
def _counted(batches):
    features, raw, target = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches, 200):
        each = [np.concatenate(features.of(t)) for t in batch.column(1).to_pylist()]
        raw += np.bincount(np.concatenate(each), minlength=BUCKETS)
        some = [x for x, role in zip(each, batch.column(2).to_pylist(), strict=True) if role == 1]
        if some:
            target += np.bincount(np.concatenate(some), minlength=BUCKETS)
    if raw.any():
        cuts = range(0, BUCKETS, BLOCK)
        yield pa.record_batch(
            [pa.array([c // BLOCK for c in cuts], pa.int32()), *(pa.array([x[c : c + BLOCK].tobytes() for c in cuts], pa.binary()) for x in (raw, target))],
            names=["block", "raw", "target"],
        )


def _summed(batches):
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, *both in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            now = [np.frombuffer(x, np.int64) for x in both]
            sums[k] = [a + b for a, b in zip(sums[k], now, strict=True)] if k in sums else now
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), *(pa.array([v[i].tobytes() for v in sums.values()], pa.binary()) for i in (0, 1))], names=["block", "raw", "target"])


def log_ratios(rows: DataFrame) -> np.ndarray:
    """log p_target / p_raw of every bucket; a bucket with little evidence is near zero."""
    schema = "block int, raw binary, target binary"
    sums = rows.mapInArrow(_counted, schema).repartition("block").mapInArrow(_summed, schema).collect()  # BUCKETS numbers
    counts = np.zeros((2, BUCKETS))
    for r in sums:
        for i, x in enumerate((r["raw"], r["target"])):
            part = np.frombuffer(bytes(x), np.int64)
            counts[i, r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    out = np.zeros(BUCKETS, np.float32)
    for a, b in zip(FROM, (*FROM[1:], BUCKETS), strict=True):
        raw, target = counts[0, a:b], counts[1, a:b]
        if target.sum() and raw.sum():
            expected = raw * (target.sum() / raw.sum())
            out[a:b] = np.clip(np.log((target + PRIOR) / (expected + PRIOR)), -6, 3)
    return out


def described(features: Features, text: str | None, ratios: np.ndarray) -> tuple[float, list[float]]:
    """(log weight, what the calibrator sees)."""
    weight, seen = 0.0, []
    for buckets in features.of(text):
        lr = ratios[buckets]
        n, low = max(1, len(lr)), int((lr < LOW).sum())
        weight += float(lr.sum())
        seen += [float(lr.sum()) / n, low / n, np.log1p(low), float(np.minimum(lr, 0).sum()) / n]
    return weight, [*seen, np.log1p(n), 1.0]


def _sums(train: DataFrame, of) -> np.ndarray:
    """The sum over train(bad, x) of of(bad, x), numbers of any one shape, as each task adds them up."""

    def run(batches):
        total = None
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            if len(x):
                now = of(np.asarray(batch.column(0)), x)
                total = now if total is None else total + now
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r["sums"] for r in train.select("bad", "x").mapInArrow(run, "sums array<double>").collect()], axis=0)


def fit(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, scale and weights of a ridge logistic regression on train(bad, x), a written table, by Newton steps; None without rows of both kinds."""
    n, bad = (x or 0 for x in train.agg(F.count(F.lit(1)), F.sum("bad")).first())
    if not 0 < bad < n:
        return None
    mean = _sums(train, lambda _, x: x.sum(0)) / n
    scale = np.sqrt(_sums(train, lambda _, x: ((x - mean) ** 2).sum(0)) / n)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    w = np.zeros(len(mean))
    ridge = np.full(len(w), 0.01 * n**0.5)
    ridge[-1] = 1e-6

    def slopes(bad, x):
        z = (x - mean) / scale
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return np.r_[z.T @ (bad - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]

    for _ in range(30):
        sums = _sums(train, slopes)
        step = np.linalg.solve(sums[len(w) :].reshape(len(w), -1) + np.diag(ridge), sums[: len(w)] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def quantile(rows: DataFrame, c: str, q: float) -> float:
    """The quantile q of c between its two ranks. Percentiles enclose these; only the values in between are ranked, each once."""
    n = rows.count()
    at, slack = (n - 1) * q, 2e-5 + 2 / n
    low, high = rows.select(F.percentile_approx(c, [max(0.0, q - slack), min(1.0, q + slack)], 100_000)).first()[0]
    below = rows.where(F.col(c) < low).count()
    values = rows.where(F.col(c).between(low, high)).groupBy(F.col(c).alias("v")).count().orderBy("v").collect()  # a few of 100,000 rows
    upto = below + np.cumsum([r["count"] for r in values])
    a, b = (values[int(np.searchsorted(upto, min(rank, n - 1), side="right"))]["v"] for rank in (int(at), int(at) + 1))
    return float(a + (b - a) * (at - int(at)))


def scored(docs: DataFrame, labels: DataFrame, most_labelled: int | None = MOST_LABELLED, extra: list[str] | None = None) -> DataFrame:
    """doc_id, log_weight, bad (the calibrator's log odds over its threshold), keep, and the extra columns of docs as x0, x1, ..."""
    extra = extra or []
    known = _known(labels, most_labelled)
    ratios = log_ratios(_marked(docs, known.where("role = 1")))

    @lean
    def run(batches):
        features = Features()
        for batch in sliced(batches):
            got = [described(features, t, ratios) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.float64()))]
            yield pa.record_batch([*columns, *(batch.column(2 + i) for i in range(len(extra)))], names=["doc_id", "log_weight", "x", *(f"x{i}" for i in range(len(extra)))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)))
    kinds = "".join(f", x{i} {t}" for i, (_, t) in enumerate(docs.select(*extra).dtypes)) if extra else ""
    rows = materialize(rows.mapInArrow(run, "doc_id long, log_weight double, x array<double>" + kinds), "described")
    train = rows.select("doc_id", "x").join(known.where("role > 1"), "doc_id")
    train = materialize(train.select((F.col("role") == 3).cast("double").alias("bad"), "x"), "train")
    over = F.lit(-1.0)
    if (model := fit(train)) is not None:
        mean, scale, w = model
        odds = sum(((F.col("x")[i] - float(m)) / float(d) * float(v) for i, (m, d, v) in enumerate(zip(mean, scale, w, strict=True))), F.lit(0.0))
        over = odds - max(0.0, quantile(train.where("bad = 0").select(odds.alias("odds")), "odds", 1 - FALSE_REJECTS))
    return rows.withColumn("bad", over).select("doc_id", "log_weight", "bad", (F.col("bad") <= 0).alias("keep"), *(f"x{i}" for i in range(len(extra))))


def resampled(scores: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """scores with draw (log weight plus Gumbel noise) and sampled: the ceil(share x rows) greatest draws.

    Equal draws go by doc_id; rows at the cut that agree in both are all sampled. The cut is found exactly: percentiles enclose it, and only the
    rows between them are ranked.
    """
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = materialize(scores.withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform))), "draws")
    n = drawn.count()
    k = -int(-share * n // 1)
    if not 0 < k < n:
        return drawn.withColumn("sampled", F.lit(k >= n))
    slack = 2e-5
    p = 1 - k / n
    low, high = drawn.select(F.percentile_approx("draw", [max(0.0, p - slack), min(1.0, p + slack)], 100_000)).first()[0]
    above = drawn.where(F.col("draw") > high).count()
    between = drawn.where(F.col("draw").between(low, high)).select("doc_id", "draw")
    rank = F.row_number().over(Window.orderBy(F.desc("draw"), "doc_id"))
    edge = between.withColumn("rank", rank).where(F.col("rank") == max(1, k - above)).first()
    inside = F.struct(-F.col("draw"), F.coalesce("doc_id", F.lit(-(1 << 63)))) <= F.struct(F.lit(-edge["draw"]), F.lit(edge["doc_id"] if edge["doc_id"] is not None else -(1 << 63)))
    return drawn.withColumn("sampled", inside)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, all columns as they are."""
    own = scored(docs, labels, extra=docs.columns).where("keep")
    return own.select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(docs.columns)))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    scores = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return resampled(scores, 0.5).select("doc_id", "log_weight", "bad", "keep", "draw", "sampled")
