"""Each training-data operator against a plain version of itself, on small and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from lattica.llm import decontaminate, digest, ngram_scores, packing, quality, redirects, simhash, substrings, tokenstore, wrappers
from lattica.llm.common import Ranges, connected_components, key_ranges, materialize
from lattica.llm.wordpieces import WordPieces

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(3)
WORDS = [f"w{i}{'xyz'[i % 3] * (i % 4)}" for i in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SHARED = prose(60)
BASE = prose(120)
#: Null, empty, blank and long texts, exact and near copies, a shared passage, odd characters; a null and a repeated id.
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace(BASE.split()[7], "changed", 1)), (4, None), (5, ""), (6, " \n\t "), (7, f"{prose(20)} {SHARED} {prose(30)}"),
    (8, f"{SHARED} {prose(5)}"), (9, "one two"), (10, "the " * 90), (11, "Ünïcode ﬁ ＡＢＣ x ý 😀"), (12, prose(3000)), (None, prose(50)), (14, prose(40)), (14, prose(41)), (2, BASE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame([(d, t, "en", 7) for d, t in TEXTS], "doc_id long, text string, part string, hits int"), "docs").select("doc_id", "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (1, 1), (None, 2), (3, 7)], "src long, dst long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (7, 3), (8, 8), (9, 8)}


def test_tokens_equal_the_tokenizer():
    own, whole = WordPieces(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in TEXTS] + ["it's they'll ''s 'D x", "ΣΑΣ é <|endoftext|> a<|startoftext|>b", "12,000 ½ ² ª × ÷", "日本語 x\x00y", "İ ǅ a\u0085b"]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(docs, none):
    rows = packing.pack(docs, PATH).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    whole = Tokenizer.from_file(PATH)
    lengths = [len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS]
    assert sum(r["length"] for r in rows) == sum(lengths)
    assert len(sequences) == -(-sum(lengths) // packing.CAPACITY)
    assert packing.pack(none, PATH).count() == 0
    joined = packing.sequences(packing.pack(docs, PATH, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * sum(lengths)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_equal_brute_force(spark, capacity):
    """Each piece once, with its place, ids and checksum; only documents over the capacity are cut; sequences without gaps."""
    whole = Tokenizer.from_file(PATH)
    own = random.Random(capacity)
    texts = [None, "", "one", prose(2500)] + [prose(own.randrange(1, 60)) for _ in range(200)] + [prose(30)] * 40
    want = collections.Counter()
    for d, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())] += 1
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), PATH, capacity).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= capacity
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / capacity) * 1.05 + 1


def test_plan_fits_any_histogram():
    for seed in range(4):
        h = np.zeros(257, np.int64)
        for x in np.random.default_rng(seed).integers(1, 257, 3000):
            h[x] += 1
        runs, n = packing.plan(h, 256)
        back = np.bincount(runs[:, 0], runs[:, 2], 257)
        assert (back == h).all() and n <= math.ceil((h * np.arange(257)).sum() / 256) * 1.03


def test_token_store(spark, docs, none):
    whole = Tokenizer.from_file(PATH)
    stored = materialize(tokenstore.blocks(docs, PATH, 2, Ranges([5, 9])), "blocks")
    got = sorted(tokenstore.stored_documents(stored).collect(), key=lambda r: r["start"])
    ids = [(d, whole.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in TEXTS]
    want = collections.Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] or -1 for r in got] == sorted(d or -1 for d, _ in ids)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    found = tokenstore.lookup(stored, spark.createDataFrame([(9,), (12,), (77,)], "doc_id long"), Ranges([5, 9])).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {d: x for d, x in ids if d in (9, 12)}
    assert tokenstore.stored_documents(materialize(tokenstore.blocks(none, PATH, 2, Ranges([])), "blocks")).count() == 0


def test_token_store_of_a_hot_key(spark, monkeypatch):
    """Records of one key, and of no key, go on over blocks and shards."""
    monkeypatch.setattr(tokenstore, "BLOCK_IDS", 40)
    rows = [(None, f"a{k}") for k in range(60)] + [(2**60 + 1, f"b{k % 30}") for k in range(60)] + [(2**60 + 2 * k, None if k % 5 == 0 else prose(k % 9)) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ranges = tokenstore.shards(frame, 10)
    stored = materialize(tokenstore.blocks(frame, PATH, 2, ranges), "blocks")
    assert stored.agg(F.max("n_ids")).first()[0] <= 200
    got = sorted(tokenstore.stored_documents(stored).collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(PATH)
    ids = [(d, whole.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == collections.Counter((d, zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert [r["doc_id"] or -1 for r in got] == sorted(d or -1 for d, _ in rows)
    found = tokenstore.lookup(stored, spark.createDataFrame([(2**60 + 1,), (2**60 + 4,), (3,)], "doc_id long"), ranges).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in found) == collections.Counter((d, tuple(x)) for d, x in ids if d in (2**60 + 1, 2**60 + 4))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    slots = tokenstore.PerfectHash.of(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_ranges_of_any_keys(spark):
    own = random.Random(4)
    for keys in ([2**60 + k * 10**9 for k in range(300)], [2**62 + k for k in range(300)], [own.randrange(-(2**63), 2**63) for _ in range(300)], [7] * 200 + list(range(100)), [None] * 150 + list(range(150)), [5], []):
        rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
        ranges = key_ranges(rows, 20)
        hashes = np.array([own.randrange(-(2**63), 2**63) for _ in keys], np.int64)
        plain = np.array([-(2**63) if k is None else k for k in keys], np.int64)
        parts = ranges.of(plain, hashes)
        order = np.lexsort((hashes, plain))
        assert (np.diff(parts[order]) >= 0).all() and (len(parts) == 0 or parts.max() < len(ranges))
        assert all(int(p) in ranges.spanned(int(k)) for p, k in zip(parts, plain, strict=True))
        assert len(keys) < 100 or np.bincount(parts).max() <= 60


def test_digests(spark, docs, none):
    rows = spark.createDataFrame([(1, "Straße  X"), (2, "STRASSE x "), (3, "ﬁn"), (4, "FIN"), (5, None), (6, " ")], "doc_id long, text string")
    groups = {r["doc_id"]: r["group_id"] for r in digest.exact_groups(rows).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    texts = [t for _, t in TEXTS]
    for ids in (range(len(texts)), [2**60 + k * 10**9 for k in range(40)], [2**62 + 1 + k for k in range(40)], [k * 2**57 - 2**62 for k in range(40)], [-k for k in range(40)]):
        unique = sorted((d, texts[k % len(texts)]) for k, d in enumerate(ids))
        given = unique[:]
        random.Random(1).shuffle(given)
        frame = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
        for size in (1, 4, 1000):
            got = {r["doc_id"]: r for r in digest.compare_edited(frame, rows_a_range=size).collect()}
            assert len(got) == len(unique)
            for (d, t), (_, after) in zip(unique, unique[1:] + unique[:1], strict=True):
                t, after = t or "", after or ""
                new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
                form = digest.canonical(t)
                assert (got[d]["edited_sha256"], got[d]["n_chars"], got[d]["digest"], got[d]["edited_digest"]) == (hashlib.sha256(new.encode()).hexdigest(), len(t), digest.digest(form), digest.digest(digest.canonical(new)))
                assert got[d]["near_next"] == float(form == digest.canonical(after)) and got[d]["near_edited"] == float(form == digest.canonical(new))
    assert digest.compare_edited(docs).count() == len(TEXTS) and digest.compare_edited(none).count() == 0


def test_digests_of_an_id_that_many_rows_share(spark):
    """A third of the rows without an id, a third with one: divided by hash, each row once, one cycle through all."""
    rows = [(None, f"a{k}") for k in range(40)] + [(7, f"b{k}" if k % 2 else "same") for k in range(40)] + [(k, f"c{k}") for k in range(40)]
    got = digest.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows_a_range=5).collect()
    assert collections.Counter((r["doc_id"], r["digest"]) for r in got) == collections.Counter((d, digest.digest(digest.canonical(t))) for d, t in rows)
    starts = collections.Counter(t[0] for _, t in rows)
    ends = collections.Counter()
    shas = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest(): u[0] for _, t in rows for _, u in rows}
    for r in got:
        ends[shas[r["edited_sha256"]]] += 1
    assert starts == ends


def test_digest_collisions(spark, monkeypatch):
    """Texts whose digests collide have fingerprints of their own, repeated ids and edited texts too."""
    rows = spark.createDataFrame([(1, "aa"), (1, "bb"), (2, "aa"), (3, "cc"), (3, "cc"), (4, "bb")], "doc_id long, text string")
    found = rows.select("doc_id", F.lit("0" * 32).alias("digest"), F.sha2(F.encode("text", "utf-8"), 256).alias("form"), F.lit("0" * 32).alias("edited_digest"), F.sha2(F.encode(F.lit("bb"), "utf-8"), 256).alias("edited_form"))
    monkeypatch.setattr(digest, "collisions", lambda docs, found: found.select("digest").distinct())
    named = digest.confirmed(rows, found, {"edited_digest": "edited_form"}).collect()
    assert len(named) == 6
    by = collections.defaultdict(set)
    for r in named:
        by[r["form"]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == 3
    assert {r["edited_fingerprint"] for r in named} == by[hashlib.sha256(b"bb").hexdigest()]


def test_digest_collisions_are_found(spark):
    found = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    assert digest.collisions(found, digest.digests(found)).count() == 0


def windows_removed(texts, window):
    """By brute force: for each text the words covered by a window that starts anywhere else too."""
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out.append(gone)
    return words, out


def kept_digest(words, gone):
    kept = [x for x, g in zip(words, gone, strict=True) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


DIGEST = "n_words long, n_removed long, kept_sha256 string"


def test_substrings(docs, none):
    words, gone = windows_removed([t for _, t in TEXTS], 35)
    want = [(d, *kept_digest(w, g)) for (d, _), w, g in zip(TEXTS, words, gone, strict=True)]
    got = substrings.parsed(docs, substrings._digest_of, DIGEST).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert substrings.deduplicated(docs).count() == len(TEXTS) and substrings.deduplicated(none).count() == 0


@pytest.mark.parametrize("window", [3, 9, 35])
def test_substrings_of_patched_texts(spark, window):
    """Texts put together from pieces of each other, periodic ones, repeated rows."""
    own = random.Random(window)
    letters = [f"{k}" for k in range(30 if window < 35 else 300)]
    pieces = [[own.choice(letters) for _ in range(own.randrange(1, 3 * window))] for _ in range(25)]
    texts = [" ".join(w for _ in range(own.randrange(1, 6)) for w in own.choice(pieces) + [own.choice(letters)] * own.randrange(3)) for _ in range(150)]
    texts += ["x " * 200, "x y " * 100, texts[0], texts[0], None, ""]
    words, gone = windows_removed(texts, window)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.parsed(rows, substrings._digest_of, DIGEST, window).collect()}
    assert got == {k: kept_digest(w, g) for k, (w, g) in enumerate(zip(words, gone, strict=True))}


def test_substrings_compare_words_not_hashes(spark):
    """With word hashes of four bits nearly all windows collide: nothing is removed that isn't there twice."""
    own = random.Random(8)
    letters = [f"{k}" for k in range(40)]
    shared = [own.choice(letters) for _ in range(30)]
    texts = [" ".join([own.choice(letters) for _ in range(60)] + (shared if k % 3 == 0 else []) + [own.choice(letters) for _ in range(20)]) for k in range(60)]
    words, gone = windows_removed(texts, 5)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = substrings.parsed(rows, lambda raw, spans: (",".join(str(i) for a, b in spans for i in range(a, b)),), "gone string", 5, bits=1).collect()
    removed = 0
    for r in found:
        places = [int(i) for i in r["gone"].split(",") if i]
        assert all(gone[r["doc_id"]][i] for i in places)
        removed += len(places)
    assert removed > 0


def test_factors_of_one_reference_travel_together(spark):
    # two words over and over: a factor every other word, all of the same place
    rows = spark.createDataFrame([(i, f"begin{i} " + "left right " * 60 + f"end{i}") for i in range(6)], "doc_id long, text string")
    plain = substrings._identified(rows)
    found, each = substrings.referred(plain), substrings.parse(plain)
    assert found.count() <= 2 * 6 and each.count() > 100
    quotes = substrings.quoted(plain, substrings.materialize(found, "factors")).collect()
    opened = zstandard.ZstdDecompressor()
    assert sum(len(opened.decompress(q["words"]).split()) for r in quotes for q in r["quotes"]) < 6 * 130
    got = {r["doc_id"]: r for r in substrings.parsed(rows, substrings._digest_of, DIGEST).collect()}
    assert all(got[i]["n_removed"] == 120 and got[i]["kept_sha256"] == hashlib.sha256(f"begin{i} end{i}".encode()).hexdigest() for i in range(6))
    assert substrings.stretches([(10, 5), (40, 3), (12, 6), (10, 5)]) == ([(10, 18), (40, 43)], [0, 8, 2, 0])


def test_factors_have_references(spark):
    base = prose(200).split()
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(["a", "b", *base[50:120], "c"])), (3, " ".join([*base[10:60], *base[150:200]])), (4, prose(100))], "doc_id long, text string")
    plain = substrings._identified(rows)
    found = sorted(tuple(r)[:1] + tuple(r)[2:5] + (r["rat"],) for r in substrings.parse(plain).collect() if r["doc"] in (2, 3))
    assert found == [(2, 2, 70, 1, 50), (3, 0, 50, 1, 10), (3, 50, 50, 1, 150)]


@pytest.mark.parametrize("window", [3, 9, 35])
def test_words_of_many_texts_are_hashed_at_once(window, monkeypatch):
    own = random.Random(window)
    letters = b"ab \t\n\x0b\x1c\x85\xc3\xa9\x00\xff "
    raws = [bytes(own.choices(letters, k=own.randrange(300))) for _ in range(80)] + [b"", b" ", b"q" * 32 + b" " + b"q" * 33 + b" " + b"q" * 34]
    found, begin = substrings.word_hashes(raws)
    assert np.diff(begin).tolist() == [len(r.split()) for r in raws]
    pairs = set(zip((w for r in raws for w in r.split()), found.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    for words in (found, found & np.uint64(1)):  # with ties
        want = []
        for t, (a, b) in enumerate(zip(begin, begin[1:], strict=False)):
            seeds = [int(x) for x in substrings.rolled(words[a:b], min(8, window))] if b - a >= window else []
            places = [min(range(i, i + window - min(8, window) + 1), key=lambda j: (seeds[j], j)) for i in range(b - a - window + 1)]
            starts = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
            want += [(seeds[places[i]], t, a + i, a + j) for i, j in zip(starts, [*starts[1:], len(places)], strict=False)]
        assert list(zip(*(x.tolist() for x in substrings.anchored(words, begin, window)), strict=True)) == want
    monkeypatch.setattr(substrings.xxhash, "xxh64_intdigest", lambda *_: pytest.fail("a word by itself"))
    batch = pa.record_batch([pa.array([prose(100), None, prose(50)])], names=["text"])
    assert sum(b["n"].to_numpy().sum() for b in substrings._anchors(window, 64)(iter([batch]))) > 0


def test_spans():
    words = [b"%d" % (k % 7) for k in range(40)]
    other = words[5:25]
    assert substrings.spans(words, [(5, other)], 4) == [(5, 25)]
    other = [*other[:9], b"z", *other[10:]]
    assert substrings.spans(words, [(5, other)], 4) == [(5, 14), (15, 25)] and substrings.spans(words, [(5, other)], 10) == [(15, 25)]
    assert substrings.spans(words, [(38, [b"3", b"4", b"5"])], 2) == [(38, 40)] and substrings.spans(words, [], 4) == []


@pytest.fixture(scope="module")
def clashing(spark):
    """Extra columns named as the operators' own, a null, an empty, a very long text, repeated rows and ids."""
    names = "hits h z doc vid keys row r1 r2 k1 k2 node component fp bits role x0 c0 n part key ids shard part_before rank digest form text_ n_chars".split()
    long = prose(60_000)
    texts = [(1, BASE), (2, BASE), (2, BASE), (None, None), (5, ""), (6, long), (7, f"{long} end"), (8, f"{prose(10)} {SHARED}"), (9, f"{SHARED} {prose(10)}"), (9, "another text of the same id")]
    kinds = ", ".join(f"{n} {'long' if n == 'n_chars' else 'string'}" for n in names)
    return materialize(spark.createDataFrame([(d, t, *[len(t or "") if n == "n_chars" else n for n in names]) for d, t in texts], f"doc_id long, text string, {kinds}"), "clashing")


def test_operators_with_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(1, 1, 0, 7), (2, 0, 0, 7), (2, 0, 1, 7)], "doc_id long, quality int, toxic int, text int")
    bench = spark.createDataFrame([(0, " ".join(BASE.split()[20:60]), 3)], "item_id long, text string, doc_id int")
    assert substrings.deduplicated(clashing).columns == clashing.columns
    cut = {(r["doc_id"], r["text"]): r for r in substrings.deduplicated(clashing).collect()}
    assert len(cut[9, "another text of the same id"]) == len(clashing.columns) and all(r["h"] == "h" and r["z"] == "z" and r["n_chars"] == len(r["text"]) for r in cut.values())
    kept = simhash.one_of_each(clashing)
    rows = kept.collect()
    assert kept.columns == clashing.columns and collections.Counter(r["doc_id"] for r in rows) == collections.Counter([1, 6, 8, 9, 9, 5]) and all(r["row"] == "row" and r["r1"] == "r1" for r in rows)
    assert quality.kept(clashing, labels).columns == clashing.columns and quality.kept(clashing, labels.limit(0)).count() == clashing.count()
    clean = decontaminate.clean(clashing, bench)
    assert clean.columns == clashing.columns and {r["doc_id"] for r in clean.collect()} == {None, 5, 6, 7, 8, 9}
    assert decontaminate.clean(clashing, bench.limit(0)).count() == clashing.count()
    assert packing.pack(clashing, PATH).agg(F.sum("length")).first()[0] > 60_000
    assert digest.compare_edited(clashing).count() == digest.exact_groups(clashing).count() == clashing.count() == ngram_scores.stupid_backoff(clashing).count()
    assert tokenstore.stored_documents(materialize(tokenstore.blocks(clashing, PATH, 2, tokenstore.shards(clashing, 2)), "blocks")).count() == clashing.count()
    assert simhash.simhash_components(clashing).count() == clashing.count()


def test_simhash(docs, none):
    rows = docs.collect()
    got = simhash.simhash_components(docs).collect()
    want = {}
    for d, t in [tuple(r) for r in rows]:
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        want.setdefault(d, set()).add(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    fps = collections.defaultdict(set)
    for r in got:
        fps[r["doc_id"]].add(r["fp"] & (1 << 64) - 1)
    assert fps == want
    nodes = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got]
    up = list(range(len(nodes)))
    for _ in nodes:  # the least index of a component, by brute force
        up = [min(up[j] for j, (_, g) in enumerate(nodes) if (f ^ g).bit_count() <= 4) for _, f in nodes]
    for i, r in enumerate(got):
        least = min(d for (d, _), u in zip(nodes, up, strict=True) if u == up[i] and d is not None) if r["doc_id"] is not None else None
        assert r["component_id"] == least
    assert simhash.simhash_components(none).count() == 0


def alike(texts, least=0.8):
    """Components over an exact Jaccard similarity of five-word shingles, as sets of indexes."""
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) >= least * len(a | b)) if a or b else True:
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return set(map(frozenset, groups.values()))


def test_near_copies_equal_brute_force(spark, none):
    """Copies with any share of their words changed, short ones too: just those of similarity 0.8 or more are joined."""
    own = random.Random(21)
    texts = []
    for _ in range(60):
        base = [own.choice(WORDS) for _ in range(own.choice((6, 9, 14, 30, 80, 200)))]
        texts.append(" ".join(base))
        for _ in range(4):
            changed = base[:]
            for _ in range(own.choice((0, 1, 1, 2, 4))):
                changed[own.randrange(len(changed))] = own.choice(WORDS)
            texts.append(" ".join(changed) if own.random() < 0.8 else " ".join(changed).upper())
    texts += [None, "", "  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    groups = collections.defaultdict(set)
    for r in simhash.near_copies(rows).collect():
        groups[r["component"]].add(r["doc_id"])
    assert set(map(frozenset, groups.values())) == alike(texts)
    assert {r["doc_id"] for r in simhash.one_of_each(rows).collect()} == {min(g) for g in alike(texts)}
    assert simhash.one_of_each(none).count() == 0


def test_one_of_each_of_repeated_ids(spark):
    """Of equal rows one stays, and a row's fate isn't that of another with its id."""
    rows = [(1, BASE), (1, BASE), (1, prose(50)), (2, BASE), (2, prose(60)), (None, BASE), (None, prose(70)), (None, None), (3, None), (4, "")]
    kept = simhash.one_of_each(spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, place long").repartition(3)).collect()
    assert sorted(r["place"] for r in kept if r["place"] > 1) == [2, 4, 6, 8] and len(kept) == 5


def test_least_forest():
    i, j, d = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]), np.array([9, 5, 4, 1])
    assert sorted(simhash._forest(i, j, d, 5).tolist()) == [1, 2, 3]


@pytest.mark.parametrize("n", [40, 300])
def test_bit_slices(n):
    r = np.random.default_rng(n)
    values = r.integers(0, 1 << 63, n).astype(np.uint64)
    values[n // 2 :] = values[: n - n // 2] ^ (np.uint64(1) << r.integers(0, 63, n - n // 2).astype(np.uint64)) ^ np.uint64(6)
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    for radius in (0, 3, 4, 22):
        assert (simhash.near_lanes((values[:, None] ^ values[None, :]).ravel(), radius).reshape(n, n) == (distance <= radius)).all()
        hits = {(i, int(j)) for i, js in simhash.near_block(values, values, radius) for j in js}
        assert hits == set(zip(*map(lambda x: x.tolist(), np.nonzero(distance <= radius)), strict=True))


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 60)
    values = [int(x) for x in {(1 << i) | (1 << j) | (1 << 60) for i in range(20) for j in range(20)}]
    edges = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert connected_components(edges).select("component").distinct().count() == 1


def test_redirects(spark):
    rows = [
        (1, "http://a.example.com/de/1#x", ""), (2, "https://b.net/x", '<link href="http://A.example.com/de/1" rel=canonical>'), (3, "http://c.net/y", "<meta http-equiv='refresh' content='0; url=http://b.net/x#q'>"),
        (4, None, None), (5, "nourl", ""), (6, "http://c.net/z", '<link rel="canonical" href="/y">'), (7, "http://x.org/q", '<link rel="canonical" href="//k.net/e">'), (8, "http://k.net/e", '<link rel="canonical" href="http://c.com/de/">'),
        (9, "http://z.net?a=1", ""), (10, "HTTP://EXAMPLE.ORG/es/", ""), (11, "http://notexample.org/es/", ""),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in redirects.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v[3] == "block"} == {1, 2, 3, 6, 10}
    assert got[8][3] == "allow"  # its class holds a blocked url and an allowed one
    assert got[4] == got[5] == ("", "", None, "allow") and got[9][:2] == ("z.net", "") and got[11][2] == "org/"


def test_link_targets():
    of = lambda url, html: redirects.targets(url, html)
    assert of("http://a.net/d/e?q#f", '<link href="http://b.net/x?a=1&amp;b=2" rel="Canonical alternate">') == ["http://b.net/x?a=1&b=2"]
    assert of("http://a.net/d/e", '<link rel=canonical href="?y=1"><link rel=canonical href=../z>') == ["http://a.net/d/e?y=1", "http://a.net/z"]
    assert of("http://a.net/d/e", "<base href='/k/'><meta http-equiv=refresh content='3;URL=\"n\"'>") == ["http://a.net/k/n"]
    assert of("http://a.net/", '<!-- <link rel=canonical href=/x> --><script>"<link rel=canonical href=/y>"</script><link rel=canonical href="mailto:z@z">') == []
    assert of(None, "<link rel=canonical href=/x>") == of("nourl", "<link rel=canonical href=/x>") == of("http://a.net", None) == []


def test_redirects_equal_brute_force(spark):
    own = random.Random(12)
    hosts = ["a.net", "x.com", "www.example.org", "k.org", "b.net"]
    urls = [f"http://{own.choice(hosts)}/{own.choice(('de', 'fr', 'es', 'en', 'q'))}/{k % 60}" for k in range(300)]
    pages = [(k, u, "".join(f"<link rel='canonical' href='{own.choice(urls)}'>" for _ in range(own.choice((0, 0, 1, 1, 2))))) for k, u in enumerate(urls)] + [(900, None, None), (900, None, None), (901, urls[0], None)]
    table = [(own.choice(urls), own.choice(urls)) for _ in range(20)] + [(None, urls[0])]
    node = lambda u: u.split("://")[1]
    links = [(node(u), node(to)) for _, u, html in pages for to in re.findall("href='(.*?)'", html or "")] + [(node(a), node(b)) for a, b in table if a]
    group = {n: {n} for pair in links for n in pair}
    for a, b in links:
        if group[a] is not group[b]:
            both = group[a] | group[b]
            group.update(dict.fromkeys(both, both))

    def rule(n):
        host, _, path = n.partition("/")
        fit = [(len(h) + len(p), v, h + p) for v, h, p in redirects.RULES if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    want = collections.Counter()
    for k, u, _ in pages:
        own_verdict, which = rule(node(u)) if u else (None, None)
        shared = {rule(n)[0] for n in group.get(node(u), ())} if u else set()
        want[k, which, own_verdict or ("allow" if "allow" in shared else "block" if "block" in shared else "allow")] += 1
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = redirects.judged(frame, spark.createDataFrame(table, "from_url string, to_url string")).collect()
    assert collections.Counter((r["page_id"], r["rule"], r["verdict"]) for r in got) == want
    assert redirects.judged(frame.limit(0)).count() == 0


def texts_of(page):
    return [u.text for u in wrappers._units(wrappers.parse(page))]


def test_parse_of_legal_and_broken_pages():
    assert texts_of("<head><title>t</title><meta charset=x><body><p>one</p>") == ["one"]
    assert texts_of("<svg class=a /><p>one</p><select><p>two<iframe src=x><p>three</p>") == ["one", "two", "three"]
    assert texts_of('<p title=5">one</p><p title="a>b">two</p><p title=\'c>d\'>three</p><p title="x>four') == ["one", "two", "three", "four"]
    assert texts_of("<p>a<script>var x = '<p>no</p>';") == ["a"]
    assert [(u.key, u.text) for u in wrappers._units(wrappers.parse("<p class=advert>Buy<br>now</p><br>x"))] == [("p.advert", "Buy"), ("p.advert", "now"), ("br", "x")]
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p>"
    assert texts_of(deep) == ["deep", "after"]
    assert len(texts_of("<select>" * 20_000 + "x")) == 1


def test_wrappers_where_only_the_alignment_tells(spark):
    """Boxes without names, template blocks in the middle of the article: what never changes over different pages goes, optional and repeated parts stay."""
    own = random.Random(6)
    prose_ = lambda k: " ".join(own.choice(WORDS) for _ in range(k))
    rows, want = [], {}
    for n in range(24):
        parts = [("h2", f"Title {n}"), *[("p", prose_(30)) for _ in range(1 + n % 3)]]
        parts += [("pre", prose_(12))] if n % 2 else []
        after = [("p", prose_(25)) for _ in range(1 + n % 2)]
        block = lambda items: "".join(f"<{t}>{x}</{t}>" for t, x in items)
        rows.append((n, "http://q.net/", f"<div><div><h3>Our paper, daily</h3></div><div>{block(parts)}<h5>Please support this paper today</h5>{block(after)}</div><div><h6>Printed on recycled words</h6></div></div>"))
        want[n] = "\n".join(x for _, x in parts + after)
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_wrappers_on_odd_tables(spark):
    """Deep pages, copies of one page, an empty table, repeated rows; a host of many patterns."""
    deep = "<div>" * 3000 + "<p>The deep text stays as it is</p>" + "</div>" * 3000
    copy = "<html><body><div id=content><h1>One title</h1><blockquote>A quotation</blockquote><p>Body of the article</p></div>"
    other = lambda n: f"<html><body><div id=content><h1>Title {n}</h1><p>Body {n} of it</p></div>"
    rows = [(1, "http://d.net/", deep)] + [(10 + k, "http://c.net/", copy) for k in range(12)] + [(30 + k, "http://c.net/", other(k)) for k in range(12)] + [(50, "http://c.net/", other(3))] * 2
    many = "".join
    for k in range(700):  # each page a pattern of its own
        body = many(f"<{t}>{t} {k} {i}</{t}>" for i, t in enumerate(random.Random(k).choices(["p", "h2", "pre", "h3"], k=8)))
        rows.append((1000 + k, "http://m.net/", f"<div class=menu><a href=/>Home</a></div><article>{body}</article><footer>f {k}</footer>"))
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    assert got[1] == "The deep text stays as it is" and got[50] == "Title 3\nBody 3 of it"
    assert all(got[10 + k] == "One title\nA quotation\nBody of the article" for k in range(12))
    assert all(len(got[1000 + k].split("\n")) == 8 and f" {k} " in got[1000 + k] and "Home" not in got[1000 + k] for k in range(700))
    assert wrappers.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers(spark):
    page = lambda n, body: f"<html><head><title>t{n}</title></head><body><div class='menu'><a href=/>Home</a></div><nav><ul><li><a>x{n}</a></li><li><a>y</a></li></ul></nav><div id=content><h1>Title &amp; {n}</h1>{body}<h4>Share this page</h4></div><div class='comments'><p>Reader {n} says a lot about it all</p></div><footer>&copy; {n}</footer>"
    rows = [(n, "http://h.net/p", page(n, "".join(f"<p>Some words {n} {k} <b>and\n more</b>" for k in range(1 + n % 4)))) for n in range(20)] + [(90, None, None), (91, "http://h.net/q", "")]
    got = {r["page_id"]: r["text"] for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(20):
        assert got[n] == "\n".join([f"Title & {n}", *(f"Some words {n} {k} and more" for k in range(1 + n % 4))])
    assert got[90] == got[91] == ""


def test_language_model(docs, none):
    most = 200
    words = [(d, (t or "").lower().split()) for d, t in TEXTS]
    counts = collections.Counter(w for _, x in words for w in x)
    total, steps, taken, edge = sum(counts.values()), collections.Counter(math.floor(math.log2(n) * 16) for n in counts.values()), 0, None
    for s in sorted(steps, reverse=True):
        if taken + steps[s] > most:
            break
        taken, edge = taken + steps[s], s
    own = lambda w: w if math.floor(math.log2(counts[w]) * 16) >= edge else None
    uni = collections.Counter(own(w) for _, x in words for w in x)
    pairs = collections.Counter((own(a), own(b)) for _, x in words for a, b in zip(x, x[1:], strict=False))
    want = []
    for d, x in words:
        score, backed = math.log(uni[own(x[0])] / total) if x else 0.0, 0
        for a, b in zip(x, x[1:], strict=False):
            n = pairs[own(a), own(b)]
            mine = sum((own(p), own(q)) == (own(a), own(b)) for p, q in zip(x, x[1:], strict=False))
            score += math.log(n / uni[own(a)]) if n > mine else math.log(0.4 * uni[own(b)] / total)
            backed += n == mine
        want.append((d or -1, len(x), round(score, 6), backed))
    got = [(r["doc_id"] or -1, r["n_words"], round(r["log_score"], 6), r["n_backed_off"]) for r in ngram_scores.stupid_backoff(docs, most).collect()]
    assert sorted(got) == sorted(want)
    assert ngram_scores.stupid_backoff(none).count() == 0


@pytest.mark.parametrize("numbered", [0, 40, 65_535])
def test_every_word_has_its_own_count(spark, monkeypatch, numbered):
    monkeypatch.setattr(ngram_scores, "VOCABULARY", numbered)
    monkeypatch.setattr(ngram_scores, "HOT", 8)
    monkeypatch.setattr(ngram_scores, "WORDS_A_BUCKET", 200)
    own = random.Random(9)
    words = [f"{k:x}" for k in range(80_000)]
    texts = [[own.choice(words[: own.choice((20, 300, 80_000))]) for _ in range(own.randrange(40))] for _ in range(300)]
    if numbered == 65_535:  # more words of one count than there are numbers
        texts += [words[at : at + 2000] for at in range(0, 80_000, 2000)]
    texts += [None, ["twice", "twice", "twice"]]
    uni = collections.Counter(w for x in texts for w in x or [])
    pairs = collections.Counter(p for x in texts for p in zip(x or [], (x or [])[1:], strict=False))
    total, want = sum(uni.values()), {}
    for d, x in enumerate(texts):
        score, mine, backed = math.log(uni[x[0]] / total) if x else 0.0, collections.Counter(zip(x or [], (x or [])[1:], strict=False)), 0
        for v, w in zip(x or [], (x or [])[1:], strict=False):
            score += math.log(pairs[v, w] / uni[v]) if pairs[v, w] > mine[v, w] else math.log(0.4 * uni[w] / total)
            backed += pairs[v, w] == mine[v, w]
        want[d] = (len(x or []), round(score, 5), backed)
    rows = spark.createDataFrame([(d, None if x is None else " ".join(x)) for d, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = ngram_scores.stupid_backoff(rows).collect()
    assert len(got) == len(texts) and {r["doc_id"]: (r["n_words"], round(r["log_score"], 5), r["n_backed_off"]) for r in got} == want


def test_language_model_sends_each_key_once_a_chunk(spark):
    flat = np.array([1, 2, 1, 2, 1, 70_000, 1, 70_000, 3, 90_000, 70_000, 1, 2], np.uint64)
    keys = ngram_scores._Keys(flat, np.array([5, 4, 2, 2], np.uint32))
    assert sorted(keys.pair_n.tolist()) == [2, 3] and sorted(keys.word_n.tolist()) == [1, 3] and keys.own_n.sum() == 4 and len(keys.own_n) == 4
    # many buckets: rows and bytes shuffled grow with the keys of a chunk, not with words times buckets
    text = " ".join(f"w{k % 50}" for k in range(2_000))
    rows = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string").coalesce(1)
    words = ngram_scores.word_counts(rows.select("text"))
    hashes, _, _ = ngram_scores.vocabulary(words)
    sent = rows.mapInArrow(ngram_scores._exploded(hashes, 1_000, True), ngram_scores.PACKED).select("kind", F.length("data").alias("n")).collect()
    assert len(sent) <= 1 + 50 and sum(r["n"] for r in sent if r["kind"] == ngram_scores.KEYS) < 50 * 100


def test_quality(spark, docs, none):
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(30)]
    text = lambda k: " ".join(rng.choice(bad if k % 3 == 0 and rng.random() < 0.3 else good) for _ in range(80))
    rows = spark.createDataFrame([(k, text(k)) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.resampled(quality.scored(rows, labels), 0.5).collect()}
    held = range(400, 600)
    assert np.mean([got[k]["keep"] == (k % 3 > 0) for k in held]) > 0.97
    assert sum(r["sampled"] for r in got.values()) == 300
    assert min(r["draw"] for r in got.values() if r["sampled"]) >= max(r["draw"] for r in got.values() if not r["sampled"])
    unlabelled = quality.scored(docs, labels.limit(0)).collect()
    assert len(unlabelled) == len(TEXTS) and all(r["keep"] for r in unlabelled)
    assert quality.kept(none, labels).count() == 0


def test_quality_uses_every_label(spark):
    """With more labels than 20,000 every good one counts in the target, the calibrator or both; its quantile is exact."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.col("id") % 50)).alias("text")).repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    roles = {r["role"]: r["count"] for r in quality._roles(docs, labels, quality.MOST_LABELLED).groupBy("role").count().collect()}
    assert roles.keys() == {1, 2, 3} and roles[3] == 10_000 and roles[1] + roles[2] == 20_000
    for n in (1, 2, 267, 5000):
        values = [float((k * 37) % 101) + (k > n // 2) for k in range(n)]
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.5, 0.997, 1.0):
            assert abs(quality.quantile(rows, "v", q) - float(np.quantile(values, q))) < 1e-9


def test_quality_is_fitted_by_sums(spark):
    own = np.random.default_rng(3)
    x = np.c_[own.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 3, 1], np.ones(500)]
    bad = (x[:, 0] + own.normal(size=500) > 0.5).astype(float)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[-1] = 0, 1
    z, w, ridge = (x - mean) / scale, np.zeros(4), np.array([*[0.01 * 500**0.5] * 3, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (bad - p) - ridge * w)
    train = spark.createDataFrame([(float(b), r.tolist()) for b, r in zip(bad, x, strict=True)], "bad double, x array<double>").repartition(5)
    got = quality.fit(train)
    assert np.allclose(got[0], mean) and np.allclose(got[1], scale) and np.allclose(got[2], w, atol=1e-5)
    assert quality.fit(train.where("bad = 1")) is None and quality.fit(train.limit(0)) is None


def test_quality_equals_brute_force(spark):
    """Log ratios, weights, noise and the greatest draws, recomputed one n-gram and one row at a time; repeated ids and labels."""
    own = random.Random(14)
    texts = [(k % 170, " ".join(own.choice(["Good", "plain", "words,", "12", "and", "more.", "XX", "junk"][: 5 + k % 4]) for _ in range(own.randrange(30)))) for k in range(200)] + [(None, None), (None, "some words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 7 == 0)) for k in range(120)] + [(5, 0, 0), (6, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    features, raw, target = quality.Features(), np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    roles = quality._roles(docs, labels, quality.MOST_LABELLED).collect()
    good = {k for k in range(120) if k % 3 > 0 and k % 7 and k != 5}
    assert {r["doc_id"] for r in roles if r["role"] in (1, 2)} == good and {r["doc_id"] for r in roles if r["role"] == 3} == set(range(120)) - good
    for r in roles:
        for family in features.of(r["text"]):
            for bucket in family.tolist():
                raw[bucket] += 1
                target[bucket] += r["role"] == 1
    ratios = np.zeros(quality.BUCKETS)
    for low, high in zip(quality.FROM, (*quality.FROM[1:], quality.BUCKETS), strict=True):
        share = target[low:high].sum() / raw[low:high].sum()
        for b in np.flatnonzero(raw[low:high]) + low:
            ratios[b] = min(3, max(-6, math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))))
    want = collections.Counter((d, round(sum(ratios[b] for family in features.of(t) for b in family.tolist()), 2)) for d, t in texts)
    got = quality.resampled(quality.scored(docs, labels), 0.3).collect()
    assert collections.Counter((r["doc_id"], round(r["log_weight"], 2)) for r in got) == want
    noise = {r["doc_id"]: -math.log(-math.log((r["h"] % (1 << 52) + 0.5) / (1 << 52))) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).collect()}
    assert all(abs(r["draw"] - r["log_weight"] - noise[r["doc_id"]]) < 1e-6 for r in got)
    k = math.ceil(0.3 * len(texts))
    edge = sorted((r["draw"] for r in got), reverse=True)[k - 1]
    assert {r["draw"] for r in got if r["sampled"]} == {d for d in (r["draw"] for r in got) if d >= edge}


def test_decontamination(spark, none):
    item = [prose(24).split(), prose(50).split()]
    paraphrase = [w if i % 6 else "other" for i, w in enumerate(item[1])]
    rows = [(1, f"{prose(40)} {' '.join(item[0])} {prose(40)}"), (2, f"{prose(30)} {' '.join(paraphrase)}"), (3, prose(200)), (4, None), (5, ""), (6, " ".join(item[1]).upper() + "!"), (7, " ".join(item[1][:15]) + prose(60))]
    rows += [(k, prose(80)) for k in range(10, 40)]
    bench = spark.createDataFrame([(0, " ".join(item[0])), (1, " ".join(item[1])), (2, None), (3, "...")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 0), (2, 1), (6, 1)}
    assert decontaminate.leaks(none, bench).count() == 0


def test_decontamination_of_a_large_benchmark(spark):
    own = random.Random(17)
    words = [f"v{k}" for k in range(9000)]
    text = lambda n: [own.choice(words) for _ in range(n)]
    items = [text(own.choice((5, 9, 20, 28, 45, 70))) for _ in range(3000)]
    rows, want = [], set()
    for d, i in enumerate(range(0, 3000, 5)):
        item = items[i]
        if d % 2 and len(item) >= 20:  # every fourth word another, the answer as it is
            item = [w if k % 4 or k >= len(item) * 4 // 5 else own.choice(words) for k, w in enumerate(item)]
        rows.append((d, " ".join(text(own.randrange(90)) + item + text(own.randrange(90)))))
        want.add((d, i))
    rows += [(1000 + d, " ".join(text(150))) for d in range(300)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == want


def test_exact_search_equals_brute_force():
    own = random.Random(5)
    words = [f"v{k}" for k in range(60)]
    text = lambda n: [own.choice(words) for _ in range(n)]
    items = [text(n) for n in (1, 2, 3, 4, 6, 8, 11, 15, 24, 40)]
    docs = [text(own.randrange(1, 150)) + [w for w in own.choice(items) if own.random() < 0.8] + text(own.randrange(150)) for _ in range(60)] + [[]]
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            n = len(item)
            size = n + 2 * max(4, n // 4) if n >= 4 else n
            spans = [doc[s : s + size] for s in range(max(1, len(doc) - size + 1))]
            if any(item == x if n < 4 else decontaminate.leaked(item, x)[0] for x in spans):
                want.add((d, i))
    exact = decontaminate._Exact(list(enumerate(items)), np.ones(decontaminate.TERMS + 1, np.float32))
    blocks = exact.candidates([exact.terms.of(" ".join(x)) for x in docs])
    assert {(d, i) for d, i, item, start, end in blocks if exact.leak(item, docs[d][start:end])} == want


def test_search_reads_each_text_once(monkeypatch):
    own = random.Random(11)
    text = lambda n: " ".join(own.choice(WORDS) for _ in range(n))
    texts, items = [text(100) for _ in range(20)] + [None, ""], [(i, text(n)) for i, n in enumerate((5, 20, 40))]
    texts[3] += f" {items[0][1]} {items[2][1]}"
    seen, of = collections.Counter(), decontaminate._Terms.of
    monkeypatch.setattr(decontaminate._Terms, "of", lambda self, t: (seen.update([t]), of(self, t))[1])
    vectors = np.linalg.qr(np.random.default_rng(1).standard_normal((decontaminate.TERMS + 1, 8)))[0].astype(np.float32)
    tables = type("Sent", (), {"value": (np.ones(decontaminate.TERMS + 1, np.float32), vectors)})
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], names=["doc_id", "text", "h"])
    found = [r for b in decontaminate._searched(items, tables)(iter([batch])) for r in b.to_pylist()]
    assert {(r["doc_id"], r["item_id"]) for r in found if r["leaked"]} == {(3, 0), (3, 2)}
    assert all(seen[t] == 1 for t in texts)
    for word in ("", "a", "a.", ".a", "...", "a.b", "a_", "_a", "a_b", "\u00b2.", "\u00e9!", "e\u0301", "x\u0301.", "\u0301", "3,", "a..", "_"):
        assert decontaminate._bare(word) == re.sub(r"^[\W_]+|[\W_]+$", "", word)


def test_words_of_many_texts_are_cut_at_once(monkeypatch):
    own = random.Random(3)
    odd = [*"aB9_.,' \n\x1c\x85\u00a0\u00e9\u03a3\u0130\u00df\u0301\u00b2\u4e2d\u203f\u3000", "\U0001f600", "\U00010400"]
    text = lambda letters: "".join(own.choice(letters) for _ in range(own.randrange(300)))
    texts = [text(odd if k % 3 else odd[:10]) + " x" * (k % 5) + "y" * (k % 60) for k in range(400)] + [None, "", " " * 40, "." * 40, "._a", "a._"]
    want = [[zlib.crc32(b.encode()) % decontaminate.TERMS if b else decontaminate.TERMS for b in map(decontaminate._bare, (t or "").lower().split())] for t in texts]
    monkeypatch.setattr(decontaminate._Buckets, "__missing__", lambda self, word: pytest.fail("a word by itself"))
    counts = []
    monkeypatch.setattr(decontaminate, "_sum_blocks", lambda parts, shape: (counts.append(parts), np.zeros(shape))[1])
    rows = type("Rows", (), {"mapInArrow": lambda self, run, schema: list(run(iter([pa.record_batch([pa.array([t for t in texts if t], pa.string())], names=["text"])])))})
    decontaminate.inverse_frequencies(rows())  # cuts the texts
    assert len(counts) == 1
    monkeypatch.setattr(decontaminate, "_few", lambda texts, most=0: (texts[i : i + 7] for i in range(0, len(texts), 7)))
    terms = decontaminate._Terms()
    assert [ids.tolist() for ids in terms.each([t or None for t in texts])] == want and terms.each([]) == []


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(50):
        a, b = [rng.choices("abcd", k=rng.randrange(1, 90)) for _ in range(2)]
        assert decontaminate.common_subsequence(a, b)[0] == plain(a, b)


def test_latent_space_is_fitted_on_the_whole_benchmark_and_no_sample(spark):
    rng = np.random.default_rng(3)
    bench = spark.createDataFrame([(i, " ".join(f"b{x}" for x in rng.integers(0, 3000, 30))) for i in range(100)], "item_id long, text string")
    rows = decontaminate._fit_rows(bench)
    fitted = sorted(r["ids"] for r in rows.collect())
    terms = decontaminate._Terms()
    assert fitted == sorted(p.tolist() for r in bench.collect() for _, p in decontaminate.query_passages(terms.of(r["text"]))[1])
    idf = np.ones(decontaminate.TERMS + 1, np.float32)
    vectors = decontaminate.basis(rows, idf)
    assert min(decontaminate.latent_share(np.array(ids), idf, vectors) for ids in fitted) > decontaminate.SHARE


def test_runs_of_variants_are_gathered_by_document(spark):
    passage = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    found = substrings.indexed(substrings._identified(docs), window=10)
    assert "explode(places" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc"]: sorted({k for x in r["runs"] for k in range(x["at"], x["at"] + x["n"])}) for r in found.collect()} == {i: list(range(1, 192)) for i in range(40)}
