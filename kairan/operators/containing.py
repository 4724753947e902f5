"""Which of many names stand in a text: an index of names by hashes, joined with what texts hold of it.

A name's length lies between a power of two and its double, so the name is its first and its last so many characters. A
text's hashes of all stretches of such a length come from those of half the length by one vectorised step. Two filters of
bits, of bounded size for any number of names, tell which stretches begin a name and which begin and end one; what passes
both is a candidate. Candidates are joined with the names by equality, so the filters only save work, and neither names
nor texts pass through the driver. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each name, and at most.
BITS, MOST_BITS = 64, 1 << 28
#: Bits of a row of Spark's bitmap functions.
ROW_BITS = 32768
#: Characters of a text that are hashed at a time.
STRETCH = 500_000
#: Pairs of a name's beginning and a length that are looked up at a time.
PAIRS = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left * _ODD[0] ^ (right + _ODD[2]) * _ODD[1]
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD[2]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def stretches(text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all stretches of 1, 2, 4 ... ``longest`` characters, by their first place."""
    hashes, n = _joined(_codes(text), np.ones(1, np.uint64)), 1
    while n <= longest and len(hashes):
        yield n, hashes
        hashes, n = _joined(hashes[:-n], hashes[n:]), n * 2


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _whole(first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _joined(first, last) + length.astype(np.uint64) * _ODD[1]


def _name_hashes(name: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The greatest power of two within the name's length; hashes of its beginning and of all of it, as arrays of one."""
    n, hashes = list(stretches(name, len(name)))[-1]
    return n, hashes[:1], _whole(hashes[:1], hashes[len(name) - n :][:1], np.array([len(name)]))


class Finder:
    """The filters and the lengths of names by their power of two."""

    def __init__(self, beginnings: np.ndarray, wholes: np.ndarray, lengths: list[int]):
        self.filters, self.bits = (beginnings, wholes), len(beginnings) * 8
        powers: dict[int, list[int]] = {}
        for x in lengths:
            powers.setdefault(1 << (x.bit_length() - 1), []).append(x)
        self.lengths = {n: np.array(x, np.int64) for n, x in powers.items()}
        self.longest = max(lengths, default=0)

    def passed(self, filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        one, two = _places(hashes, self.bits)
        found = np.flatnonzero(filter_[one >> 3] >> (one & 7).astype(np.uint8) & 1)
        two = two[found]
        return found[(filter_[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]

    def candidates(self, text: str) -> set[str]:
        """Distinct stretches of a text that may be names; all names that it holds are among them."""
        out: set[str] = set()
        for at in range(0, len(text), STRETCH):
            part = text[at : at + STRETCH + self.longest - 1]
            for n, hashes in stretches(part, self.longest):
                if n not in self.lengths:
                    continue
                begins, lengths = self.passed(self.filters[0], hashes), self.lengths[n]
                for i in range(0, len(begins), max(1, PAIRS // len(lengths))):
                    some = begins[i : i + max(1, PAIRS // len(lengths))]
                    first, length = np.repeat(some, len(lengths)), np.tile(lengths, len(some))
                    first, length = (x[first + length <= len(part)] for x in (first, length))
                    found = self.passed(self.filters[1], _whole(hashes[first], hashes[first + length - n], length))
                    out.update(part[x : x + y] for x, y in zip(first[found].tolist(), length[found].tolist(), strict=True))
        return out


def finder(names: DataFrame, key: str = "key") -> Finder:
    """The filters over all non-empty names; they and the distinct lengths of names are all that the driver sees."""
    keys = names.select(F.col(key).alias("key")).filter("key <> ''").distinct()
    lengths = {r[0]: r[1] for r in keys.groupBy(F.length("key")).count().collect()}
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (BITS * sum(lengths.values()) - 1).bit_length() if lengths else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_name_hashes(x)[1:] for x in batch.column(0).to_pylist()]
            places = [np.concatenate(_places(np.concatenate([f[i] for f in found]), bits)) if found else np.empty(0, np.int64) for i in (0, 1)]
            which = np.repeat([0, 1], [len(p) for p in places])
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.concatenate(places))], ["which", "place"])

    rows = keys.mapInArrow(run, "which int, place long").groupBy("which", F.floor(F.col("place") / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits"))
    filters = np.zeros((2, bits // 8), np.uint8)
    for which, row, raw in rows.toLocalIterator():
        filters[which, row * (ROW_BITS // 8) : (row + 1) * (ROW_BITS // 8)] = np.frombuffer(raw, np.uint8)
    return Finder(filters[0], filters[1], sorted(lengths))
