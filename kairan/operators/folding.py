"""Folding ordered events per key with a state that is carried from batch to batch, never with a key's events in one row.

Rows are dealt by key and sorted within partitions; one pass over a partition's Arrow batches carries the state of the
key at hand. A key's events may span any number of batches: memory holds one batch and one state. A key stays in one
task, for its events build on each other; other keys are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of results that are held before they are passed on.
HELD = 20_000


def _sorted(events: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], start: DataFrame | None) -> DataFrame:
    """Keys, ``_start``, ``fields`` in order; a key's start row, whose fields are null, goes first.

    ``start`` has keys and one more column, the state to begin from.
    """
    if start is None:
        rows = events.select(*keys, F.lit(None).cast("string").alias("_start"), *fields)
    else:
        state = next(c for c in start.columns if c not in keys)
        none = F.lit(None).cast(start.schema[state].dataType)
        begun = start.select(*keys, F.col(state).alias("_start"), *(F.lit(None).cast(events.schema[f].dataType).alias(f) for f in fields))
        rows = begun.unionByName(events.select(*keys, none.alias("_start"), *fields))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *(F.col(f).asc_nulls_first() for f in fields))


def _walk(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch with its rows as (key, whether it is new, start state of a start row or None, fields)."""
    key = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        rows = []
        for now, start, *fields in zip(zip(*columns[:n_keys], strict=True), *columns[n_keys:], strict=True):
            rows.append((now, now != key, start, fields))
            key = now
        yield batch, rows


def fold(events: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], begin: Callable[[Any], Any], change: Callable[..., Any], finish: Callable[[Any], tuple], schema: str | T.StructType, start: DataFrame | None = None) -> DataFrame:
    """A row a key: ``keys`` and the ``schema`` fields that ``finish`` makes of the key's last state.

    ``begin`` gets the state of ``start`` (None where the key has none), ``change(state, *fields)`` gives the next one;
    events go in order of ``fields``, which end with whatever settles ties. A key with a start and no event keeps it.
    """
    more = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*(events.schema[k] for k in keys), *more.fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, done, state, at = to_arrow_schema(kind), [], None, None

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
            done.clear()
            return out

        for _, rows in _walk(batches, n):
            for key, new, begun, values in rows:
                if new:
                    if at is not None:
                        done.append((*at, *finish(state)))
                    at, state = key, begin(begun)
                    if begun is not None:
                        continue
                state = change(state, *values)
            if len(done) > HELD:
                yield passed()
        if at is not None:
            done.append((*at, *finish(state)))
        if done:
            yield passed()

    return _sorted(events, keys, fields, start).mapInArrow(run, kind)


def trace(events: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], begin: Callable[[Any], Any], change: Callable[..., Any], tell: Callable[[Any], tuple], schema: str | T.StructType, start: DataFrame | None = None) -> DataFrame:
    """A row an event: ``keys``, ``fields`` and the ``schema`` fields that ``tell`` makes of the state after it."""
    more = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*(events.schema[k] for k in keys), *(events.schema[f] for f in fields), *more.fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, state = to_arrow_schema(kind), None
        for batch, rows in _walk(batches, n):
            told, kept = [], []
            for i, (_, new, begun, values) in enumerate(rows):
                if new:
                    state = begin(begun)
                    if begun is not None:
                        continue
                state = change(state, *values)
                told.append(tell(state))
                kept.append(i)
            if told:
                own = [c for i, c in enumerate(batch.columns) if i != n]
                own = [c.take(pa.array(kept)) if len(kept) < len(rows) else c for c in own]
                new_ = [pa.array(x, f.type) for x, f in zip(zip(*told, strict=True), list(arrow)[len(own) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow, strict=False)), *new_], schema=arrow)

    return _sorted(events, keys, fields, start).mapInArrow(run, kind)

