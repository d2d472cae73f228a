"""Selection queries on literal graphs."""

import pytest

from lattica.operators import index
from lattica.plans.ast import QueryError, normalise
from lattica.plans.nested import Graph, resolve, select


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame(
        [
            ("p1", "ann", 30.0, "p2", ["t1", "t2", "t1", None, "t9", "t3"], ["soul", "name", "age", "friend", "tasks"]),
            ("p2", "bob", None, "p9", [], ["name", "age", "friend", "tasks"]),
            ("p3", "cid", None, None, None, ["name"]),
            ("p4", "dan", float("nan"), "p1", ["t3"], ["name", "age", "friend", "tasks"]),
        ],
        "soul string, name string, age double, friend string, tasks array<string>, _fields array<string>",
    )
    tasks = spark.createDataFrame([("t1", 5, ["x", "y"]), ("t2", None, ["z"]), ("t3", 9, [])], "soul string, prio int, tags array<string>")
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)], "soul string, next string")
    return Graph({"p": people, "t": tasks, "n": chain}, {("p", "friend"): "p", ("p", "tasks"): "t", ("n", "next"): "n"})


ALL = ["p1", "p2", "p3", "p4"]


def souls(df):
    return [r["soul"] for r in df.collect()]


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ({"age": {"$ne": 5}}, ["p1", "p2", "p4"]),  # absent is turned away, null is not
        ({"age": {"$gte": 0}}, ["p1", "p2"]),  # null is 0, NaN is nothing
        ({"age": None}, ["p2"]),
        ({"age": {}}, ["p1", "p2", "p4"]),
        ({"age": "30"}, []),
        ({"name": {"$in": ["ann", "cid", 4]}}, ["p1", "p3"]),
        ({"name": {"$in": "ann"}}, []),
        ({"name": {"$in": []}}, []),
        ({"name": {"$gt": "ann", "$lt": "d"}}, ["p2", "p3"]),
        ({"nothing": {"$ne": 1}}, []),
        ({"age": {"$gt": 29}, "name": "ann"}, ["p1"]),
    ],
)
def test_filter(graph, condition, want):
    assert souls(select(graph, "p", {"souls": ALL, "filter": condition})) == want


def test_filter_on_arrays(graph):
    q = {"souls": ["t1", "t2", "t3"], "filter": {"tags": {"$in": ["y", "q"]}}}
    assert souls(select(graph, "t", q)) == ["t1"]


def test_roots(graph):
    assert souls(select(graph, "p", {"souls": ["p3", "p1", "p3", "none"]})) == ["p3", "p1"]
    assert souls(select(graph, "p", {"soul": "p2"})) == ["p2"]
    assert souls(select(graph, "p", {"soul": "none"})) == []
    assert select(graph, "p", {"souls": ["p1"], "select": ["name"], "mapToRows": True}).columns == ["name"]
    with pytest.raises(QueryError):
        select(graph, "p", {"select": ["name"]})


def test_order_and_cuts(graph):
    q = {"souls": ["p3", "p2", "p1"], "select": ["name", "age"]}
    assert souls(select(graph, "p", {**q, "sort": "age"})) == ["p1", "p3", "p2"]
    assert souls(select(graph, "p", {**q, "sort": ["age", "desc"]})) == ["p1", "p3", "p2"]
    assert souls(select(graph, "p", {**q, "sort": "friend"})) == ["p3", "p2", "p1"]  # not shown: no order
    assert souls(select(graph, "p", {**q, "sort": ["name", "desc"], "offset": 1, "limit": 1})) == ["p2"]
    assert souls(select(graph, "p", {**q, "limit": 0})) == []
    assert souls(select(graph, "p", {**q, "offset": 0, "limit": 2})) == ["p3", "p2"]
    for bad in ("limit", "offset"):
        with pytest.raises(QueryError):
            select(graph, "p", {**q, bad: -1})


def test_single_refs(graph):
    rows = select(graph, "p", {"souls": ALL, "buddy": {"via": "friend", "select": ["name"], "filter": {"name": "bob"}}}).collect()
    assert [r["buddy"] and r["buddy"]["name"] for r in rows] == ["bob", None, None, None]


def test_lists(graph):
    rows = select(graph, "p", {"souls": ALL, "tasks": {"list": True, "select": ["prio"]}}).collect()
    assert [[t["soul"] for t in r["tasks"]] for r in rows] == [["t1", "t2", "t3"], [], [], ["t3"]]
    q = {"list": True, "select": ["prio"], "sort": ["prio", "desc"], "offset": 1, "limit": 5}
    rows = select(graph, "p", {"souls": ["p1"], "tasks": q}).collect()
    assert [t["soul"] for t in rows[0]["tasks"]] == ["t1", "t2"]


def test_depth(graph):
    q = {"soul": "n0", "maxDepth": 1, "next": {"maxDepth": 9, "next": {"select": ["soul"], "next": {}}}}
    row = select(graph, "n", q).first()
    assert row["next"]["next"]["_depthExceeded"] is True and "next" not in row["next"]["next"].__fields__
    assert select(graph, "n", {"soul": "n0", "maxDepth": 0, "next": {}}).first()["next"]["_depthExceeded"] is True


def test_names(graph):
    root = normalise({"soul": "a", "limit": {"via": "friend", "select": ["name"]}, "x": 5, "filter": {"list": True}})
    assert [k for k, _ in root.query.children] == ["limit", "filter"] and root.query.limit is None and root.query.filter == ()
    with pytest.raises(QueryError):
        normalise({"soul": "a", "filter": {"k": {"$regex": "x"}}})
    with pytest.raises(QueryError):
        normalise({"soul": "a", "filter": {"k": [1]}})


def test_resolve_and_index(graph, spark):
    assert resolve(graph, "p", "p1", "friend").first()["name"] == "bob"
    assert resolve(graph, "p", "p1", "name").first()["value"] == "ann"
    nodes = spark.createDataFrame([("user:1",), ("user:2",), ("post:9",)], "soul string")
    assert souls(index.prefix(nodes, "user:")) == ["user:1", "user:2"]
    assert souls(index.souls_between(nodes, "post:", "user:")) == ["post:9"]
    assert index.point(nodes, "nope:0").count() == 0
    entries = spark.createDataFrame([("a", 1.0, "old", 0), ("a", 1.0, "new", 1), ("b", 2.0, "x", 0)], "soul string, timestamp double, entry string, source int")
    assert {(r["soul"], r["entry"]) for r in index.newest(entries).collect()} == {("a", "new"), ("b", "x")}


def test_prefix_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "nodes")
    index.write_sorted(spark.createDataFrame([(f"user:{i}", i) for i in range(50)], "soul string, v int"), path)
    nodes = spark.read.parquet(path)
    plan = index.prefix(nodes, "user:1")._jdf.queryExecution().toString()
    assert "StringStartsWith(soul,user:1)" in plan
    assert index.statistics(nodes).agg({"entries": "sum"}).first()[0] == 50
