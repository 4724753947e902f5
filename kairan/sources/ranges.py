"""JSON arrays and objects of any size, read by byte ranges: one file is many tasks, and no task holds a file.

Where a range begins, nobody knows yet whether that is within a string or how deep. A first pass tells for each range, for
both cases, whether it ends within a string and how much deeper; sums over a file's ranges then give each its beginning.
A second pass cuts the elements that begin in each range, reading on to an element's end where it lies beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairan.sources.store import stored

#: Bytes of a range, and of a task's ranges, tasks of a pass at most, and bytes that are read on at first for an element's
#: end (no more than the range has).
RANGE_BYTES, TASK_BYTES, TASKS, MORE = 32 << 20, 32 << 20, 10_000, 1 << 16

_QUOTE, _ESCAPE, _COMMA = 34, 92, 44
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[91, 123]], _DEEPER[[93, 125]] = 1, -1


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _from(file, start: int, size: int) -> int:
    """The first place from ``start`` on whose byte before isn't an escape: there a range begins."""
    while 0 < start < size and file.read_at(1, start - 1) == b"\\":
        start += 1
    return min(start, size)


def _read(path: str, start: int, stop: int, size: int, more: int = 0) -> tuple[int, int, np.ndarray]:
    """Where a range begins and ends, and its bytes, with ``more`` behind them."""
    with _open(path) as file:
        a, b = _from(file, start, size), _from(file, stop, size)
        return a, b, np.frombuffer(file.read_at(max(0, min(b + more, size) - a), a), np.uint8)


def _quotes(raw: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end strings: an odd number of escapes before makes one a character."""
    quotes = raw == _QUOTE
    for i in np.flatnonzero(quotes[1:] & (raw[:-1] == _ESCAPE)) + 1:
        n = 1
        while i - n - 1 >= 0 and raw[i - n - 1] == _ESCAPE:
            n += 1
        quotes[i] = n % 2 == 0
    return quotes


def _states(raw: np.ndarray, within: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it is outside of strings, and the depth behind it."""
    quotes = _quotes(raw)
    outside = ((np.cumsum(quotes) + within) % 2 == 0) & ~quotes
    return outside, depth + np.cumsum(np.where(outside, _DEEPER[raw], 0))


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges over as many tasks as run at once, or more once those have over ``TASK_BYTES``: small ranges share a task."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return ranges.repartition(max(1, min(n, tasks, TASKS)), "path", "start")


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """``path``, ``size``, ``start``, ``stop`` of all ranges of all files; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    return _dealt(files.select("path", "size", starts.alias("start")).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("size"))))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, _, raw = _read(path, start, stop, size)
            ends = [_states(raw, within, 0)[1] for within in (False, True)]
            flips = bool(_quotes(raw).sum() % 2)
            out.append((flips, *(int(e[-1]) if len(e) else 0 for e in ends)))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(columns, (pa.bool_(), pa.int64(), pa.int64()), strict=True))], ["path", "size", "start", "stop", "flips", "out", "within"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that begin in each range: behind the outer bracket, and behind each comma at depth 1."""
    for batch in batches:
        for path, size, start, stop, within, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b, raw = _read(path, start, stop, size)
            outside, behind = _states(raw, within, depth)
            opens = outside & (_DEEPER[raw] == 1) & (behind == 1)
            begins = np.flatnonzero(opens | (outside & (raw == _COMMA) & (behind == 1))) + 1
            more = 0
            while len(begins):  # the last one's end may lie beyond the range
                ends = np.flatnonzero(outside & (((raw == _COMMA) & (behind == 1)) | ((_DEEPER[raw] == -1) & (behind == 0))))
                if len(ends) and ends[-1] >= begins[-1] or a + len(raw) >= size:
                    break
                more = more * 2 or min(MORE, stop - start)
                raw = _read(path, start, stop, size, more)[2]
                outside, behind = _states(raw, within, depth)
            # broken: something besides blanks outside of the outer brackets, a second pair of them, or no end of them
            top = np.flatnonzero(~(outside & np.isin(raw, (9, 10, 13, 32))))
            first = a == 0 and (not len(top) or raw[top[0]] not in (91, 123))
            again = ((behind == 1) & outside & (_DEEPER[raw] == 1)).sum() > (a == 0)
            outer = (behind[top] == 0) & (_DEEPER[raw[top]] != -1) | (behind[top] < 0)
            ending = (int(behind[-1]), bool((_quotes(raw).sum() + within) % 2)) if len(raw) else (depth, within)
            last = a + len(raw) >= size and ending != (0, False)
            broken = bool(first or again or outer.any() or last)
            where = np.searchsorted(ends, begins) if len(begins) else []
            texts, data = [], raw.tobytes()
            for x, i in zip(np.asarray(begins).tolist(), np.asarray(where).tolist(), strict=True):
                texts.append(data[x : int(ends[i]) if i < len(ends) else len(data)])
            kind = chr(raw[top[0]]) if a == 0 and len(top) else None
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * (len(texts) + 1), pa.string()),
                    pa.array([a] * (len(texts) + 1), pa.int64()),
                    pa.array([-1, *range(len(texts))], pa.int64()),
                    pa.array([kind, *(t.decode("utf-8", "replace") for t in texts)], pa.string()),
                    pa.array([broken] + [False] * len(texts), pa.bool_()),
                ],
                ["path", "start", "nth", "element", "broken"],
            )


def read_elements(spark: SparkSession, path: str, outer: str = "[", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``ord`` (place from 0), ``v`` (variant) of the elements of JSON arrays (or entries of objects, ``{``).

    An entry of an object is an object of that entry alone. A file whose content isn't one whole JSON array (or object)
    gives no rows, as if it were read in one piece.
    """
    ranges = _ranges(spark, path, range_bytes)
    told = stored(ranges.mapInArrow(_summed, "path string, size long, start long, stop long, flips boolean, out long, within long"), "ranges")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("inside", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("within")).otherwise(F.col("out"))
    placed = placed.select("path", "size", "start", "stop", "inside", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth"))
    found = _dealt(placed).mapInArrow(_elements, "path string, start long, nth long, element string, broken boolean")
    text = F.col("element") if outer == "[" else F.concat(F.lit("{"), "element", F.lit("}"))
    parsed = stored(found.withColumn("v", F.when(F.col("nth") >= 0, F.try_parse_json(text))), "elements")
    counts = parsed.groupBy("path", "start").agg(F.count_if(F.col("nth") >= 0).alias("n"))
    bases = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    blank = F.col("element").rlike(r"^[\t\n\r ]*$")
    bad = F.col("broken") | ((F.col("nth") >= 0) & (F.col("v").isNull() | blank))
    files = parsed.groupBy("path").agg(F.count_if(bad).alias("bad"), F.max(F.when(F.col("nth") < 0, F.col("element"))).alias("outer"))
    whole = files.filter((F.col("outer") == outer) & (F.col("bad") == 0)).select("path")  # an empty array's one blank element gives no row
    return parsed.filter("nth >= 0").join(whole, "path", "left_semi").join(bases, ["path", "start"]).select("path", (F.col("base") + F.col("nth")).alias("ord"), "v")
