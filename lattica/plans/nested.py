"""Selection queries as DataFrames: roots, filter, projection, references, order and cuts.

Nodes are wide tables by collection: soul, typed field columns and, where absent fields
matter, _fields (the names present). A reference is a column of souls, a reference list a
column of arrays of souls. Each level is resolved once for all its nodes and joined to its
parents on the soul, so a query of any depth is a fixed number of joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import Every, Query, QueryError, Root, normalise

SOUL, FIELDS, CUT = "soul", "_fields", "_depthExceeded"
#: For souls of a root: every node of the collection.
ALL = Every()


@dataclass
class Graph:
    """Node tables by collection, and where the references of a collection lead.

    refs: (collection, field) -> collection, or several whose nodes it may lead to. inverse:
    (collection, field) -> (collection, column) for a list that its members hold: those whose
    column is the soul, in the order of their souls. Such a list is joined on the members' own
    column, without an array of souls.
    """

    nodes: Mapping[str, DataFrame]
    refs: Mapping[tuple[str, str], str | tuple[str, ...]] = field(default_factory=dict)
    inverse: Mapping[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def named(self, collection: str | tuple[str, ...]) -> DataFrame:
        """The nodes of a collection, or of several by name."""
        if isinstance(collection, str):
            return self.nodes[collection]
        first, *others = (self.nodes[c] for c in collection)
        for other in others:
            first = first.unionByName(other, allowMissingColumns=True)
        return first


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array"}.get(type(t), "object")


def _kind_of(x) -> str:
    return "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "null" if x is None else "object"


def _equal(c: Column, kind: str, x) -> Column:
    if x is None:
        return c.isNull()
    if kind != _kind_of(x) or kind in ("array", "object"):
        return F.lit(False)  # other types never equal, nested values only themselves
    same = F.coalesce(c == F.lit(x), F.lit(False))
    return same & ~F.isnan(c.cast("double")) if kind == "number" else same


def _ordered(c: Column, kind: str, op: str, x) -> Column:
    """Relational comparison with JavaScript's coercions: null is 0, true is 1, text against numbers is parsed."""
    wanted = _kind_of(x)
    if "object" in (kind, wanted) or kind == "array":
        raise QueryError(f"{op} needs scalar values")
    if kind == "string" and wanted == "string":
        left, right = c, F.lit(x)  # null against text is false unless the text is a number
    else:
        as_number = {"number": lambda v: v.cast("double"), "boolean": lambda v: v.cast("int").cast("double"), "string": lambda v: v.try_cast("double"), "null": lambda v: v.cast("double")}
        left = F.when(c.isNull(), 0.0).otherwise(as_number[kind](c))
        right = F.lit(0.0) if x is None else as_number[wanted](F.lit(x))
    test = {"$gt": left > right, "$gte": left >= right, "$lt": left < right, "$lte": left <= right}[op]
    if not (kind == "string" and wanted == "string"):
        test = test & ~F.isnan(left) & ~F.isnan(right)  # Spark's NaN is the greatest number
    return F.coalesce(test, F.lit(False))


def _condition(nodes: DataFrame, name: str, tests: tuple) -> Column:
    if name not in nodes.columns or name == FIELDS:
        return F.lit(False)  # a field that no node has
    c, t = F.col(f"`{name}`"), nodes.schema[name].dataType
    kind = _kind(t)
    out = F.array_contains(FIELDS, name) if FIELDS in nodes.columns and name != SOUL else F.lit(True)
    for op, x in tests:
        if op == "$eq":
            out &= _equal(c, kind, x)
        elif op == "$ne":
            out &= ~_equal(c, kind, x)
        elif op == "$in":
            if not isinstance(x, (list, tuple)) or not x:
                out &= F.lit(False)
            elif kind == "array":
                inner = _kind(t.elementType)
                fit = [v for v in x if _kind_of(v) == inner]
                out &= F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, fit))), F.lit(False)) if fit else F.lit(False)
            else:
                any_of = F.lit(False)
                for v in x:
                    any_of |= _equal(c, kind, v)
                out &= any_of
        else:
            out &= _ordered(c, kind, op, x)
    return out


def filtered(nodes: DataFrame, query: Query) -> DataFrame:
    for name, tests in query.filter:
        nodes = nodes.where(_condition(nodes, name, tests))
    return nodes


def _order(query: Query, columns: list[str], last: str) -> list[Column]:
    """The sort of a level: missing last either way, ties as they came; a field that is not shown sorts nothing."""
    if query.sort is None or query.sort[0] not in columns:
        return [F.col(last)]
    c = F.col(f"`{query.sort[0]}`")
    return [c.desc_nulls_last() if query.sort[1] else c.asc_nulls_last(), F.col(last)]


def _level(graph: Graph, collection: str, query: Query, depth: int, most: int, nodes: DataFrame | None = None, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The resolved objects of a level, and the names of their columns; keep: columns carried along."""
    nodes = filtered(graph.named(collection) if nodes is None else nodes, query)
    keep = keep or []
    shown = [f for f in dict.fromkeys(query.select) if f in nodes.columns and f not in (SOUL, FIELDS, CUT)]
    children = [] if depth > most else list(query.children)
    vias = list(dict.fromkeys((c.via or alias) for alias, c in children if (c.via or alias) in nodes.columns))
    out = nodes.select(SOUL, *keep, *(F.col(f"`{f}`") for f in shown), *(F.col(f"`{v}`").alias(f"__via_{v}") for v in vias))
    names = [SOUL, *shown]
    if depth > most:
        return out.withColumn(CUT, F.lit(True)), [*names, CUT]
    for alias, child in children:
        via = child.via or alias
        if alias in (SOUL, CUT):
            continue
        if alias in names:
            out, names = out.drop(alias), [n for n in names if n != alias]
        target, held = graph.refs.get((collection, via)), graph.inverse.get((collection, via))
        if held is not None and child.list:
            out = _held(graph, *held, child, depth, most, out, alias)
        elif target is None or via not in vias:
            out = out.withColumn(alias, F.array() if child.list else F.lit(None))
        elif child.list:
            out = _list(graph, target, child, depth, most, out, via, alias)
        else:
            out = _single(graph, target, child, depth, most, out, via, alias)
        names.append(alias)
    return out.drop(*(f"__via_{v}" for v in vias)), names


def _object(names: list[str]) -> Column:
    return F.struct(*(F.col(f"`{n}`") for n in names))


def _single(graph, target, child, depth, most, parents, via, alias) -> DataFrame:
    objects, names = _level(graph, target, child, depth + 1, most)
    objects = objects.select(F.col(SOUL).alias("__ref"), _object(names).alias(alias))
    return parents.join(objects, F.col(f"__via_{via}") == F.col("__ref"), "left").drop("__ref")


def _list(graph, target, child, depth, most, parents, via, alias) -> DataFrame:
    objects, names = _level(graph, target, child, depth + 1, most)
    links = parents.select(F.col(SOUL).alias("__parent"), F.posexplode(f"__via_{via}").alias("__pos", "__ref")).where("__ref is not null")
    links = links.groupBy("__parent", "__ref").agg(F.min("__pos").alias("__pos"))
    rows = links.join(objects.withColumnRenamed(SOUL, "__soul"), F.col("__ref") == F.col("__soul")).withColumn(SOUL, F.col("__soul"))
    rank = "__pos"
    if child.sort is not None or child.limit is not None or child.offset:
        w = Window.partitionBy("__parent").orderBy(*_order(child, names, "__pos"))
        rows, rank = rows.withColumn("__rank", F.row_number().over(w)), "__rank"
        rows = _cut(rows, child)
    return _with_lists(parents, rows, rank, names, alias)


def _held(graph, target, column, child, depth, most, parents, alias) -> DataFrame:
    """The list of the nodes whose column is the parent's soul."""
    rows, names = _level(graph, target, child, depth + 1, most, graph.named(target).withColumn("__parent", F.col(column)).where("__parent is not null"), ["__parent"])
    rank = SOUL
    if child.sort is not None or child.limit is not None or child.offset:
        w = Window.partitionBy("__parent").orderBy(*_order(child, names, SOUL))
        rows, rank = rows.withColumn("__rank", F.row_number().over(w)), "__rank"
        rows = _cut(rows, child)
    return _with_lists(parents, rows, rank, names, alias)


def _cut(rows: DataFrame, child: Query) -> DataFrame:
    start = child.offset or 0
    rows = rows.where(F.col("__rank") > start) if start else rows
    return rows if child.limit is None else rows.where(F.col("__rank") <= start + child.limit)


def _with_lists(parents: DataFrame, rows: DataFrame, rank: str, names: list[str], alias: str) -> DataFrame:
    """parents with the objects of rows(__parent) as a list by rank."""
    lists = rows.groupBy("__parent").agg(F.collect_list(F.struct(F.col(rank).alias("k"), _object(names).alias("o"))).alias("__all"))
    # by rank alone: what a list holds need not be orderable
    by_rank = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    lists = lists.select(F.col("__parent").alias("__of"), F.transform(F.array_sort("__all", by_rank), lambda x: x["o"]).alias(alias))
    out = parents.join(lists, F.col(SOUL) == F.col("__of"), "left").drop("__of")  # parents may themselves carry a __parent
    return out.withColumn(alias, F.coalesce(alias, F.array()))


def select(graph: Graph, collection: str, query: dict | Root) -> DataFrame:
    """The rows of a query, in order. souls may be a list, ALL, or a DataFrame with soul and, for their order, ord."""
    root = query if isinstance(query, Root) else normalise(query)
    nodes = graph.nodes[collection]
    q = root.query
    if root.single:
        out, names = _level(graph, collection, q, 0, root.max_depth, nodes.where(F.col(SOUL) == root.souls))
        return _rows(out.select(*(F.col(f"`{n}`") for n in names)), root)
    if isinstance(root.souls, Every):
        out, names = _level(graph, collection, q, 0, root.max_depth, nodes)
        if q.sort is not None or q.limit is not None or q.offset:
            out = out.orderBy(*_order(q, names, SOUL), F.col(SOUL))
        return _rows(_paged(out, q).select(*(F.col(f"`{n}`") for n in names)), root)
    if isinstance(root.souls, DataFrame):
        asked = root.souls if "ord" in root.souls.columns else root.souls.withColumn("ord", F.lit(0))
        asked = asked.groupBy(SOUL).agg(F.min("ord").alias("__ord"))
    else:
        asked = nodes.sparkSession.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(root.souls))], f"{SOUL} string, __ord int")
    out, names = _level(graph, collection, q, 0, root.max_depth, nodes.join(asked, SOUL), ["__ord"])
    order = [*_order(q, names, "__ord"), F.col(SOUL)]
    if q.sort is not None or q.limit is not None or q.offset or not isinstance(root.souls, DataFrame) or "ord" in root.souls.columns:
        out = out.orderBy(*order)
    return _rows(_paged(out, q).select(*(F.col(f"`{n}`") for n in names)), root)


def _paged(out: DataFrame, q: Query) -> DataFrame:
    out = out.offset(q.offset) if q.offset else out
    return out if q.limit is None else out.limit(q.limit)


def _rows(out: DataFrame, root: Root) -> DataFrame:
    return out.drop(SOUL) if root.rows else out


def resolve(graph: Graph, collection: str, soul: str, name: str) -> DataFrame:
    """What a field leads to: the node it refers to, else its value."""
    own = graph.nodes[collection].where(F.col(SOUL) == soul)
    target = graph.refs.get((collection, name))
    if target is None:
        return own.select(F.col(f"`{name}`").alias("value"))
    return graph.named(target).join(own.select(F.col(f"`{name}`").alias(SOUL)), SOUL, "left_semi")
