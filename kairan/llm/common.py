"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kairan.sources.store import release, stored  # noqa: F401  for the operators

#: Tables are broadcast only if their counted rows stay under this.
BROADCAST_ROWS = 200_000
#: Bytes of texts (or of one text's part) that a task holds as Python objects at a time.
SLICE_BYTES = 2_000_000
#: Bytes of a cache, and of an entry besides its key.
CACHE_BYTES, ENTRY_BYTES = 16_000_000, 160


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only.

    ``bytes.lower`` and ``bytes.split`` follow exactly these ASCII rules.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_parts(raw: bytes | None, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The ``words`` of an encoded text in parts of about ``most`` bytes, so that a very long text never is one list."""
    raw, at = (raw or b"").lower(), 0
    while at < len(raw):
        stop = at + most
        if stop < len(raw):  # go back to the last white space; a longer word is taken whole
            cut = max(raw.rfind(bytes([c]), at, stop) for c in b" \t\n\v\f\r")
            if cut < 0:
                found = [x for c in b" \t\n\v\f\r" if (x := raw.find(bytes([c]), stop)) >= 0]
                cut = min(found, default=len(raw))
            stop = cut
        if found := raw[at:stop].split():
            yield found
        at = stop + 1


def crc_mod(column: str, divisor: int):
    """crc32 of the id written as text, modulo ``divisor``; null ids count as text ``""``."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % divisor


def hash_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` by hash of ``key``, all if there are fewer: a filter in the scan, not a sort."""
    total = df.count()
    return df if total <= most else df.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int(most / total * (1 << 30)))


class Cache(dict):
    """A dictionary that makes missing values and forgets all of them when they hold about ``most`` bytes."""

    def __init__(self, make: Callable, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value, size = self.make(key), len(key) + ENTRY_BYTES
        if size > self.most // 16:
            return value
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices whose texts hold about ``most`` bytes at most (one text at least).

    Sizes come from Arrow's offsets, so that no more than a slice ever becomes Python objects.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def judged(docs: DataFrame, columns: list[str], make: Callable, fields: str, most: int = SLICE_BYTES) -> DataFrame:
    """``docs[columns]`` plus the columns in ``fields`` that a per-task judge makes of the last of ``columns``, a text.

    ``make()`` is called once a task and returns a function from a list of texts to a list of tuples of ``fields``.
    """
    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(fields).fields])

    def run(batches):
        judge, arrow = make(), to_arrow_schema(schema)
        for part in text_slices(batches, len(columns) - 1, most):
            found = list(zip(*judge(part.column(part.num_columns - 1).to_pylist()), strict=True))
            added = [pa.array(x, arrow.field(part.num_columns + i).type) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], arrow.names)

    return kept.mapInArrow(run, schema)
