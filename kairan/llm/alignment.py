"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked in the corpus.

Both token lists of a document cover the same bytes without gaps. ``pandas.merge_asof``, keyed by document, finds for
each token's start the other side's token that covers it; both directions together give all overlaps. Places where both
sides' tokens end cut the tokens into groups; tokens of both sides within a group are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, release, stored, text_slices
from .tokens import byte_level, piece_bpe, read_text, text_parts

#: Pairs of ids (the most frequent) whose counts every task holds; rarer ones are joined.
HELD_PAIRS = 200_000
#: Ids of the second vocabulary stay below this: a pair is a * RADIX + b.
RADIX = 1 << 24
#: Links of a group of several tokens on both sides, up to which it is spread into them.
SPREAD = 64
#: Tokens of both sides that are aligned together, about.
ALIGNED = SLICE_BYTES // 2


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Pairs ``a``, ``b`` (row numbers) of overlapping tokens of both sides, given ``doc`` and ``at`` (start), sorted by ``at``.

    ``at`` may run on from document to document. A token's start lies in one token of the other side, the last to begin
    there or before; each overlap begins at the start of one of its two tokens.
    """
    left, right = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    ahead = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy(np.int64)
    alone = np.ones(len(right), bool)  # tokens that begin together are found already
    alone[ahead[a["at"].to_numpy() == b["at"].to_numpy()[ahead]]] = False
    back = pd.merge_asof(right[alone], left, on="at", by="doc")
    found_a, found_b = np.concatenate([left["a"], back["a"].to_numpy(np.int64)]), np.concatenate([ahead, back["b"]])
    order = np.argsort(found_a + found_b, kind="stable")
    return pd.DataFrame({"a": found_a[order], "b": found_b[order]})


def aligned(docs_a: np.ndarray, len_a: np.ndarray, docs_b: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Group numbers of the tokens of both sides, and the overlaps; tokens have at least one byte."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start_a, start_b = end_a - len_a, end_b - len_b
    pairs = overlaps(pd.DataFrame({"doc": docs_a, "at": start_a}), pd.DataFrame({"doc": docs_b, "at": start_b}))
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    both = end_a[a] == end_b[b]  # the last overlap of each group
    group_a, group_b = np.empty(len(len_a), np.int64), np.empty(len(len_b), np.int64)
    group = np.cumsum(both) - both
    group_a[a], group_b[b] = group, group
    return group_a, group_b, pairs


def link_counts(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair of ids and number of links, for each group and pair; groups in order.

    In a group with one token on a side the overlaps are the links. Other groups of ``SPREAD`` links at most are spread
    into them; in larger ones each distinct id counts with its number, so that many tokens never make all their pairs.
    """
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    one = np.minimum(size_a, size_b) == 1
    plain = one[group_a[a]]
    some = np.flatnonzero((~one & (size_a * size_b <= SPREAD))[group_a])  # tokens of the first side, each with all of the other
    times = size_b[group_a[some]]
    beside = np.arange(times.sum()) + np.repeat(start_b[group_a[some]] - np.cumsum(times) + times, times)
    a, b = np.concatenate([a[plain], np.repeat(some, times)]), np.concatenate([b[plain], beside])
    groups, keys, counts = [group_a[a]], [ids_a[a].astype(np.int64) * RADIX + ids_b[b]], [np.ones(len(a), np.int64)]
    for g in np.flatnonzero(~one & (size_a * size_b > SPREAD)).tolist():
        x, n = np.unique(ids_a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        y, m = np.unique(ids_b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        keys.append((x.astype(np.int64)[:, None] * RADIX + y).ravel())
        counts.append((n[:, None] * m).ravel())
        groups.append(np.full(len(keys[-1]), g))
    return np.concatenate(groups), np.concatenate(keys), np.concatenate(counts)


def written(ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, decimal: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Every token's id and the sign behind it, in the order ``a1,a2|b1;a3|b2``; and each token's group."""
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    total = len(ids_a) + len(ids_b)
    at_a = np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[group_a]
    at_b = np.arange(len(ids_b)) + np.cumsum(size_a)[group_b]
    code, group = np.empty(total, np.int64), np.empty(total, np.int64)
    code[at_a], code[at_b] = ids_a * 3, ids_b * 3
    group[at_a], group[at_b] = group_a, group_b
    code[at_a[np.cumsum(size_a) - 1]] += 1  # | behind a group's last token of the first side
    code[at_b[np.cumsum(size_b) - 1]] += 2  # ; behind its last token
    return decimal[code].tolist(), group


class Aligner:
    """Aligns texts by two files; a text whose tokens' bytes aren't a space and the text has no tokens."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        self.a, self.b = byte_level(path_a, pattern, False), piece_bpe(path_b)
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.decimal = np.array([f"{i}{sign}".encode() for i in range(most) for sign in ",|;"], object)

    def tokens(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of both sides, part by part, and whether their bytes are the part's."""
        text = " " + text
        for n, part in enumerate(text_parts(text) if self.b.cuts else [text]):
            a = self.a.encode(part)
            b = np.array(self.b.encode(part[1:], True) if n == 0 else self.b.encode(part, False), np.int64)
            raw = part.encode("utf-8", "surrogatepass")
            whole = b"".join(map(self.b.bytes.__getitem__, b.tolist())) == raw
            whole = whole and (self.a.lossless or b"".join(map(self.a.bytes.__getitem__, a.tolist())) == raw)
            yield a, b, whole

    def align(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
        """For each part (key, ids of both sides): key, number of groups, their text, pairs of ids, numbers of links."""
        ids_a, ids_b = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        number = np.arange(len(parts))
        docs_a, docs_b = np.repeat(number, [len(p[1]) for p in parts]), np.repeat(number, [len(p[2]) for p in parts])
        group_a, group_b, pairs = aligned(docs_a, self.a.lengths[ids_a], docs_b, self.b.lengths[ids_b])
        groups, keys, times = link_counts(ids_a, group_a, ids_b, group_b, pairs)
        tokens, group_of = written(ids_a, group_a, ids_b, group_b, self.decimal)
        doc_of = np.empty(int(group_a[-1]) + 1, np.int64)
        doc_of[group_a] = docs_a
        # links by part and pair
        doc = doc_of[groups]
        order = np.lexsort((keys, doc))
        doc, keys, times = doc[order], keys[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]))
        times, keys, doc = np.add.reduceat(times, new), keys[new], doc[new]
        stops, counts = np.searchsorted(doc, number, "right"), np.bincount(doc_of, minlength=len(parts))
        ends = np.searchsorted(doc_of[group_of], number, "right")
        for i, (key, _, _) in enumerate(parts):
            x, y = (stops[i - 1], ends[i - 1]) if i else (0, 0)
            yield key, int(counts[i]), b"".join(tokens[y : ends[i]]), keys[x : stops[i]], times[x : stops[i]]

    def rows(self, texts: list[str]) -> list[tuple]:
        """``_Document.row`` of each text; ``ALIGNED`` tokens of one or more texts are aligned together, or one part's."""
        found, parts, held = [_Document() for _ in texts], [], 0

        def settle():
            for (i, a, b), (_, *rest) in zip(parts, self.align(parts), strict=True):
                found[i].add(len(a), len(b), *rest)
            parts.clear()

        for i, text in enumerate(texts):
            for a, b, whole in self.tokens(text) if text else ():
                if not whole:
                    parts[:], found[i] = [p for p in parts if p[0] != i], _Document()
                    break
                parts.append((i, a, b))
                held += len(a) + len(b)
                if held > ALIGNED:
                    settle()
                    held = 0
        if parts:
            settle()
        return [d.row() for d in found]


class _Document:
    """What the parts of one document add up to."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = 0
        self.digest, self.keys, self.times, self.held = hashlib.sha256(), [], [], 0
        self.tail = b""

    def add(self, n_a: int, n_b: int, n_groups: int, text: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        self.digest.update(self.tail + text[:-1])
        self.tail = text[-1:]
        self.keys.append(keys)
        self.times.append(times)
        self.held += len(keys)
        if self.held > ALIGNED:
            self.joined()

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and their links."""
        if len(self.keys) > 1:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.times = [keys], [np.bincount(at, np.concatenate(self.times)).astype(np.int64)]
            self.held = 0
        return (self.keys[0], self.times[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))

    def row(self) -> tuple:
        keys, times = self.joined()
        return self.n_a, self.n_b, self.n_groups, int(times.sum()), self.digest.hexdigest() if self.n_groups else "", keys, times


_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def linked_documents(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document with its counts, digest of groups, distinct pairs of linked ids and their links; ``row`` is unique."""

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate(values) if values else np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = Aligner(path_a, pattern, path_b), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in _LINKED.split(", ")]
        for slice_ in text_slices(batches, 1):
            texts = read_text(slice_.column(1))
            out = list(zip(*aligner.rows(texts), strict=True))
            ids = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([ids, slice_.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), lists(out[5]), lists(out[6])], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, _LINKED)


def frequent_pairs(counts: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The least count from which on there are ``most`` pairs at most, by a histogram of a few hundred rows; and these."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(step).count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > most:
            break
        least, held = k, held + sizes[k]
    return least, counts.filter(step >= least)


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_PAIRS) -> DataFrame:
    """Counts of tokens, groups and links of every document, and how common its links are in the corpus.

    Side A encodes a space and the text by a byte-level file, side B the text by a file whose library adds that space.
    Returns ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their
    A id's), ``count_sum`` long, ``groups_sha256`` string (of ``a1,a2|b1;a3|b2``). A pair of ids counts the rows of
    ``docs`` that hold it linked.

    A null or empty text, or one whose tokens' bytes aren't a space and the text (such as one with characters that B's
    file changes), has no tokens: zeros, and an empty digest. Repeated rows count and repeat, ties are all best, a null id
    stays null, an empty table gives no rows; other columns aren't read, so their names can't clash. Long texts are
    encoded and aligned in parts that end where both sides' tokens do.

    Counts of the ``held`` most frequent pairs are held by tasks, so that no common pair is a hot key; rarer ones are
    joined. The best count of each A id is as many rows as A has ids at most.
    """
    linked = stored(linked_documents(docs, path_a, pattern, path_b, id_col, text_col), "linked")
    counts = stored(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.shiftrightunsigned("pair", 24)
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))
    scored = counts.withColumn("a", first).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    least, common = frequent_pairs(scored, held)
    table = common.select("pair", "n", "is_best").toArrow().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(3)))
    kept = "row doc_id n_a n_b n_groups n_links groups_sha256".split()
    schema = ", ".join(x for x in _LINKED.split(", ") if x.split()[0] in kept) + ", n_best long, count_sum long, pairs array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, is_best = shared.value
        for batch in batches:
            pairs, times = batch.column(7), batch.column(8)
            key, time = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            ends = pairs.offsets.to_numpy() - pairs.offsets.to_numpy()[0]
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            at = np.where(hit, at, 0)
            sums = []
            for value in ((is_best[at] & hit) * time, n[at] * hit * time) if len(keys) else (np.zeros(len(key), np.int64),) * 2:
                total = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array((total[ends[1:]] - total[ends[:-1]]).astype(np.int64)))
            missed = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(missed, x[~hit]) for x in (key, time)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *sums, *rest], [*kept, "n_best", "count_sum", "pairs", "times"])

    judged = linked.mapInArrow(run, schema)
    rare = judged.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = scored.filter(F.floor(F.log2("n") * 16).cast("int") < least)
    more = rare.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    added = lambda name, extra: (F.col(name) + F.coalesce(extra, F.lit(0))).alias(name)
    return judged.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "b"), added("count_sum", "s"), "groups_sha256")
