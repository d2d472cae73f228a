"""Ordered folds: the rows of a key one after another, with one state in memory at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(rows: DataFrame, key: str, order: str, columns: list[str], start: Any, step: Callable, finish: Callable, name: str, kind: str = "double") -> DataFrame:
    """key, name: finish(state) after step(state, *values) over the rows of each key by order.

    Rows are dealt by key and streamed sorted, so the rows of a key are never held together.
    """
    t = rows.schema[key].dataType
    own = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[kind]
    schema = T.StructType([T.StructField(key, t), T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches):
        last, state, keys, arrow = None, None, False, None

        def out(done):
            return pa.record_batch([pa.array([k for k, _ in done], arrow), pa.array([v for _, v in done], own)], names=[key, name])

        for batch in batches:
            arrow, done = batch.column(0).type, []
            for k, *values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if not keys or k != last:
                    if keys:
                        done.append((last, finish(state)))
                    last, state, keys = k, start, True
                state = step(state, *values)
            yield out(done)
        if keys:
            yield out([(last, finish(state))])

    dealt = rows.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order)
    return dealt.select(key, *columns).mapInArrow(run, schema)
