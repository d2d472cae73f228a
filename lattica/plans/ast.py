"""Selection queries: the dict a caller writes, checked and normalised to a tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Keys of a query with a meaning of their own, and the operators of a filter.
RESERVED = frozenset("soul souls select filter sort limit offset maxDepth mapToRows via list".split())
OPERATORS = frozenset("$eq $ne $gt $gte $lt $lte $in".split())
SHAPE = frozenset({"via", "select", "list"})
DEPTH = 32


class QueryError(ValueError):
    pass


class Every:
    """Stands for every soul of a collection."""


@dataclass(frozen=True)
class Query:
    """One level: what to select, keep, order and cut, and the references to follow."""

    select: tuple[str, ...] = ()
    filter: tuple[tuple[str, tuple[tuple[str, Any], ...]], ...] = ()
    sort: tuple[str, bool] | None = None  # field, descending
    limit: int | None = None
    offset: int | None = None
    via: str | None = None
    list: bool = False
    children: tuple[tuple[str, Query], ...] = field(default=())


@dataclass(frozen=True)
class Root:
    query: Query
    souls: Any  # list of souls, one soul, or a DataFrame of souls
    single: bool
    max_depth: int = DEPTH
    rows: bool = False


def is_alias(key: str, value: Any) -> bool:
    """A reserved name is an alias if its value looks like a query; soul never is."""
    return isinstance(value, dict) and key != "soul" and (key not in RESERVED or bool(SHAPE & value.keys()))


def _count(name: str, value: Any) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
        raise QueryError(f"{name} must be a whole number")
    if value < 0:
        raise QueryError(f"{name} must not be negative")
    return int(value)


def _conditions(filters: Any) -> tuple:
    out = []
    for key, wanted in (filters or {}).items():
        if isinstance(wanted, list):
            raise QueryError(f"a condition on {key} must not be a list")
        if isinstance(wanted, dict):
            for op in wanted:
                if op not in OPERATORS:
                    raise QueryError(f"unknown operator {op} on {key}")
            out.append((key, tuple(wanted.items())))
        else:
            out.append((key, (("$eq", wanted),)))
    return tuple(out)


def level(q: dict) -> Query:
    own = lambda k: None if k in q and is_alias(k, q[k]) else q.get(k)
    sort = own("sort")
    if sort is not None:
        name, order = (sort, "asc") if isinstance(sort, str) else (sort[0], sort[1] if len(sort) > 1 else "asc")
        sort = (name, order == "desc")
    select = own("select") or ()
    children = tuple((k, level(v)) for k, v in q.items() if is_alias(k, v))
    return Query(tuple(select), _conditions(own("filter")), sort, _count("limit", own("limit")), _count("offset", own("offset")), own("via"), own("list") is True, children)


def normalise(q: dict) -> Root:
    depth = q.get("maxDepth")
    depth = int(depth) if isinstance(depth, (int, float)) and not isinstance(depth, bool) and depth >= 0 else DEPTH
    if q.get("souls") is not None and not is_alias("souls", q["souls"]):
        return Root(level(q), q["souls"], False, depth, q.get("mapToRows") is True)
    if q.get("soul"):
        return Root(level(q), q["soul"], True, depth, q.get("mapToRows") is True)
    raise QueryError("a query needs soul or souls")
