"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from lattica.llm.common import materialize

rng = random.Random(11)
GOOD, BAD = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(20)]


def prose(n):
    return " ".join(rng.choice(GOOD) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item, passage, base = prose(30), prose(60), prose(200)
    texts = {k: prose(120) for k in range(400)}
    labels = [(k, 1, 0) for k in range(0, 300)]
    for k in range(400, 700):
        texts[k] = " ".join(rng.choice(BAD if rng.random() < 0.3 else GOOD) for _ in range(120))
        labels.append((k, 0, 0) if k < 620 else (k, 1, 1) if k < 660 else (k, None, None))
    texts |= {800: base, 801: base, 802: base.replace(base.split()[9], "other", 1), 810: f"{prose(40)} {passage} {prose(40)}", 811: f"{passage} {prose(90)}", 820: f"{prose(50)} {item} {prose(20)}", 830: None}
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    good, bad = {k for k in range(400)}, {k for k in range(400, 700)}
    assert len(bad & seen["quality"].keys()) <= 3 and len(good - seen["quality"].keys()) <= 4
    kept = seen["near_dedup"].keys()
    assert 800 in kept and not {801, 802} & kept and good & seen["quality"].keys() <= kept
    cut = seen["substring_dedup"]
    assert cut.keys() == kept and all(60 < len(cut[k]["text"].split()) <= 90 and cut[k]["n_chars"] == len(cut[k]["text"]) for k in (810, 811))
    assert cut[0]["text"] == seen["quality"][0]["text"]
    assert kept - seen["decontamination"].keys() == {820}
    assert seen["packing"].keys() == seen["decontamination"].keys()


def test_stages_on_odd_documents(spark, folder):
    """Null and empty texts and ids, repeated rows, extra columns with clashing names, an empty table: no stage fails, all but the last keep the columns."""
    long = prose(30_000)
    base = prose(80)
    rows = [(1, base), (1, base), (2, base), (None, base), (3, None), (4, ""), (5, " \n"), (None, None), (6, long), (7, prose(90)), (7, prose(95)), (9_000_000_000_000_000_000, prose(40))]
    frame = materialize(spark.createDataFrame([(d, t, "h", "row", "bits", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, h string, row string, bits string, hits int"), "odd")
    kept = {"quality": len(rows), "near_dedup": None, "substring_dedup": None, "decontamination": None}
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), folder).count() == 0
        out = materialize(stage(spark, docs, folder), "odd-stage")
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == frame.columns and all(r["h"] == "h" and r["row"] == "row" for r in out.collect())
        if name == "near_dedup":
            places = {r["hits"] for r in out.collect()}
            assert places - {0, 1} == {4, 8, 9, 10, 11} and len(places & {0, 1}) == 1  # one of each group: the least id, of equal rows any one
        kept[name] = out.count()
        docs = out
    assert kept["substring_dedup"] == kept["near_dedup"] == kept["decontamination"] == 6
