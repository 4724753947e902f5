"""Ranked lexical search over posting lists in geometric blocks, without loss (after Seismic, Bruch and others 2024).

Documents are vectors of term scores, items are vectors of term weights. Each task takes its documents some thousands at
a time, makes a posting list of each term and clusters every list by the similarity of its documents. A block's summary
holds for each term the greatest score of the block's documents, so an item's product with it is no less than its score
of any of them. A block whose product is below an item's tenth best score so far is skipped; so are lists of terms whose
greatest scores all together stay below it. All others are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices, word_parts

#: Results of an item.
BEST = 10
#: Terms of items that one pass over the documents searches for, about.
PASS_TERMS = 1_000_000
#: Documents, and places in posting lists, that a task holds at a time; documents of more terms of items than ``LONG`` are
#: scored by themselves, for their blocks would be as long as they are.
CHUNK, PLACES, LONG = 4096, 200_000, 1024
#: Documents of a block, about, and the width of the sketches that lists are clustered by.
BLOCK, SKETCH = 32, 32
#: Entries of documents that are merged into summaries at a time.
MERGED = 2_000_000
#: Documents, about, whose scores give items their first bound.
SEEDS = 4096

_SEPARATORS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def term_lists(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of an encoded text, some at a time: maximal runs of ASCII letters, digits and other characters, A-Z lower."""
    return word_parts((raw or b"").translate(_SEPARATORS))


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2n + 2) / (2df + 1))) of each term; 0 for those that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


class Items:
    """Items as lists of term numbers, with the terms' weights; ``bounds`` are scores that ``BEST`` documents reach."""

    def __init__(self, lists: list[np.ndarray], weight: np.ndarray, bounds: np.ndarray):
        self.terms = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.item = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.starts = np.cumsum([0, *(len(x) for x in lists)])
        self.weight, self.bounds = weight, bounds

    def scores(self, terms: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Every item's score of one document."""
        dense = np.zeros(len(self.weight), np.int64)
        dense[terms] = x
        total = np.concatenate([[0], np.cumsum(self.weight[self.terms] * dense[self.terms])])
        return total[self.starts[1:]] - total[self.starts[:-1]]


class Best:
    """The ``BEST`` documents of each item so far: highest score, then least id (none is last)."""

    def __init__(self, n: int, bounds: np.ndarray):
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)] * n
        self.bounds = bounds.copy()

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        new = (scores >= self.bounds[item]) & (scores > 0)
        if new.any():
            s, d, m = (np.concatenate([old, x[new]]) for old, x in zip(self.found[item], (scores, ids, missing), strict=True))
            top = np.lexsort((d, m, -s))[:BEST]
            self.found[item] = s[top], d[top], m[top]
            if len(top) == BEST:
                self.bounds[item] = max(self.bounds[item], int(s[top[-1]]))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges: from each start so many."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Chunk:
    """Some documents' vectors, their posting lists and what items find in them."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, terms: np.ndarray, x: np.ndarray, items: Items):
        self.ids, self.missing, self.sizes, self.terms, self.x, self.items = ids, missing, sizes, terms, x, items
        self.starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.posted = doc[order]
        self.listed, self.list_start, self.list_size = np.unique(terms[order], return_index=True, return_counts=True)
        self.greatest = np.zeros(len(items.weight), np.int64)
        if len(order):
            self.greatest[self.listed] = np.maximum.reduceat(x[order], self.list_start)
        # documents as sketches: each term adds its weighted score to one of a few coordinates, with a sign
        mixed = terms * 0x9E3779B1 % (1 << 32)
        value = x * items.weight[terms] * np.where(mixed & 1 << 20, 1.0, -1.0)
        sketch = np.bincount(doc * SKETCH + (mixed >> 24) % SKETCH, value, len(sizes) * SKETCH).reshape(-1, SKETCH)
        self.sketch = (sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def needed(self, bounds: np.ndarray) -> np.ndarray:
        """Which of the items' terms need a search of their lists: the others' greatest scores together stay below the bound."""
        items = self.items
        most = items.weight[items.terms] * self.greatest[items.terms]
        order = np.lexsort((most, items.item))
        total = np.cumsum(most[order])
        within = total - np.concatenate([[0], total])[items.starts[:-1]][items.item]
        out = np.zeros(len(most), bool)
        out[order] = within >= bounds[items.item]
        return out & (most > 0)

    def blocks(self, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of some lists, ``MERGED`` entries at a time: each block's list; documents and block of each place; summaries."""
        docs, labels = [], []
        for k in lists.tolist():
            found = self.posted[self.list_start[k] : self.list_start[k] + self.list_size[k]]
            label = np.zeros(len(found), np.int64)
            if len(found) >= 2 * BLOCK:
                centres = found[np.linspace(0, len(found) - 1, -(-len(found) // BLOCK)).astype(np.int64)]
                label = np.argmax(self.sketch[found] @ self.sketch[centres].T, axis=1)
                order = np.argsort(label, kind="stable")
                found, label = found[order], label[order]
            docs.append(found)
            labels.append(label)
        doc, list_ = np.concatenate(docs), np.repeat(lists, [len(d) for d in docs])
        label = np.concatenate(labels)
        new = np.concatenate([[True], (list_[1:] != list_[:-1]) | (label[1:] != label[:-1])])
        block, first = np.cumsum(new) - 1, np.flatnonzero(new)
        entries = np.cumsum(np.add.reduceat(self.sizes[doc], first))
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(entries, (entries[at - 1] if at else 0) + MERGED, "right")))
            places = slice(first[at], first[to] if to < len(first) else len(doc))
            yield list_[first[at:to]], doc[places], block[places] - at, self.summary(doc[places], block[places] - at)
            at = to

    def summary(self, doc: np.ndarray, block: np.ndarray) -> np.ndarray:
        """block << 40 | term << 20 | greatest score, sorted; scores are below a million."""
        at = spread(self.starts[doc], self.sizes[doc])
        keys = np.sort((np.repeat(block, self.sizes[doc]) << 40) | (self.terms[at] << 20) | self.x[at])
        return keys[np.concatenate([keys[1:] >> 20 != keys[:-1] >> 20, [True]])]

    def search(self, best: Best) -> int:
        """Adds what items find; returns the number of documents that were scored."""
        items, scored = self.items, 0
        needed = self.needed(best.bounds)
        wanted = np.unique(items.terms[needed])
        if not len(wanted):
            return 0
        left: dict[int, list[np.ndarray]] = {}
        weight = np.zeros(len(items.weight), np.int64)
        pairs = np.flatnonzero(needed)
        by_list = pairs[np.argsort(items.terms[pairs], kind="stable")]
        for lists, doc, block, summary in self.blocks(np.searchsorted(self.listed, wanted)):
            starts = np.searchsorted(summary >> 40, np.arange(len(lists) + 1))
            places = np.searchsorted(block, np.arange(len(lists) + 1))
            term, most = (summary >> 20) & ((1 << 20) - 1), summary & ((1 << 20) - 1)
            of = self.listed[lists]
            here = by_list[np.searchsorted(items.terms[by_list], of[0]) : np.searchsorted(items.terms[by_list], of[-1], "right")]
            for i in np.unique(items.item[here]).tolist():
                mine = items.terms[here[items.item[here] == i]]
                chosen = np.flatnonzero(np.isin(of, mine))
                if not len(chosen):
                    continue
                own = items.terms[items.starts[i] : items.starts[i + 1]]
                weight[own] = items.weight[own]
                sizes = starts[chosen + 1] - starts[chosen]
                at = spread(starts[chosen], sizes)
                bound = np.add.reduceat(most[at] * weight[term[at]], np.cumsum(sizes) - sizes)
                weight[own] = 0
                kept = chosen[bound >= best.bounds[i]]
                if len(kept):
                    left.setdefault(i, []).append(doc[spread(places[kept], places[kept + 1] - places[kept])])
        for i, found in left.items():
            docs = np.unique(np.concatenate(found))
            own = items.terms[items.starts[i] : items.starts[i + 1]]
            weight[own] = items.weight[own]
            at = spread(self.starts[docs], self.sizes[docs])
            scores = np.add.reduceat(self.x[at] * weight[self.terms[at]], np.cumsum(self.sizes[docs]) - self.sizes[docs])
            weight[own] = 0
            best.add(i, scores, self.ids[docs], self.missing[docs])
            scored += len(docs)
        return scored


def term_scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def lengths_of(n: np.ndarray, total: int, count: int) -> np.ndarray:
    """m of documents of ``n`` terms; beyond 64 bits by Python's integers."""
    if len(n) and int(n.max()) * 90 * count >= 1 << 62:
        return np.array([10 + 90 * int(x) * count // total for x in n.tolist()], np.int64)
    return 10 + 90 * n * count // total


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n`` (terms of the document), its terms of the vocabulary and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches, 1):
            sizes, terms, counts = [], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for raw in part.column(1).cast(pa.binary()):
                n, own = 0, np.empty(0, np.int32)
                times = np.empty(0, np.int32)
                for found in term_lists(raw.as_py()):
                    n += len(found)
                    own = np.concatenate([own, np.fromiter((t for w in found if (t := known.get(w)) is not None), np.int32)])
                    times = np.concatenate([times, np.ones(len(own) - len(times), np.int32)])
                    own, at = np.unique(own, return_inverse=True)
                    times = np.bincount(at, times, len(own)).astype(np.int32)
                sizes.append((n, len(own)))
                terms.append(own)
                counts.append(times)
            ends = np.cumsum([0, *(k for _, k in sizes)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in sizes], pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (a number of the item's own), ``item_id``, ``terms``: distinct, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            found = [sorted({w for ws in term_lists(raw.as_py()) for w in ws}) for raw in part.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.binary()))], ["row", "item_id", "terms"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("row"), items[id_col].alias("item_id"), items[text_col].alias("text"))
    return rows.mapInArrow(run, f"row long, item_id {kind}, terms array<binary>")


def read(batches: Iterator[pa.RecordBatch], total: int, count: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, which are missing, numbers of terms, terms and scores of ``CHUNK`` documents or ``PLACES`` terms at most."""
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy().astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = min(at + CHUNK, max(at + 1, int(np.searchsorted(ends, ends[at] + PLACES, "right")) - 1), batch.num_rows)
            part = batch.slice(at, to - at)
            sizes = np.diff(ends[at : to + 1])
            m = lengths_of(part.column(1).to_numpy(), total, count)
            tf = part.column(3).flatten().to_numpy().astype(np.int64)
            ids = part.column(0)
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            yield ids.fill_null(0).to_numpy(), missing, sizes, part.column(2).flatten().to_numpy().astype(np.int64), term_scores(tf, np.repeat(m, sizes))
            at = to


def gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Small parts put together up to about ``CHUNK`` documents or ``PLACES`` terms."""
    held, docs, places = [], 0, 0
    for part in parts:
        if held and (docs + len(part[0]) > CHUNK or places + len(part[3]) > PLACES):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, docs, places = [], 0, 0
        held.append(part)
        docs, places = docs + len(part[0]), places + len(part[3])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def search_part(parts: Iterator[tuple[np.ndarray, ...]], items: Items) -> Best:
    """The best of some documents for all items."""
    best = Best(len(items.starts) - 1, items.bounds)
    for ids, missing, sizes, terms, x in gathered(parts):
        starts = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > LONG).tolist():
            own = slice(starts[k], starts[k] + sizes[k])
            scores = items.scores(terms[own], x[own])
            for i in np.flatnonzero((scores >= best.bounds) & (scores > 0)).tolist():
                best.add(i, scores[i : i + 1], ids[k : k + 1], missing[k : k + 1])
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        if len(short):
            at = spread(starts[short], sizes[short])
            Chunk(ids[short], missing[short], sizes[short], terms[at], x[at], items).search(best)
    return best


def search(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """Each item's ``BEST`` documents by lexical score: ``item_id``, ``rank`` int from 1, ``doc_id``, ``score`` long.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that
    have terms, L terms in them all, n in a document and df documents of a term, its weight is
    floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 10 + 90nN div L, and its score sums weight *
    (10**9 tf div (1000 tf + 8m)) over the item's distinct terms. Equal scores go by ascending ``doc_id``, null last;
    documents of score 0 aren't results. Null and empty texts have no terms: such an item has no results and such a
    document doesn't count. Each row is a document or an item of its own, repeated ids too; empty tables give no rows, and
    other columns aren't read.

    Items are searched in passes of about ``pass_terms`` terms, for each of which the texts are read once; usually that is
    one. What tasks hold of a pass is its terms and items. N, L and df are counted over all documents, and a task passes on
    at most ``BEST`` documents an item.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, text_col).filter(F.size("terms") > 0), "items")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = max(1, -(-n_terms // pass_terms))
    out = None
    for k in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == k)
        found = _search_pass(spark, docs, mine, doc_col, text_col)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.filter(F.col("rank") <= BEST).join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _search_pass(spark, docs: DataFrame, mine: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """``row``, ``doc_id``, ``score`` of the best documents that each task finds for each item."""
    rows, lists, vocabulary = [], [], {}
    for r in mine.select("row", "terms").toLocalIterator():
        rows.append(r[0])
        lists.append(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r[1]], np.int64))
    index = stored(vectors(docs, vocabulary, doc_col, text_col), "vectors")
    count, total = index.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
        df[t] = n
    weight, numbers = weights(df, count), np.array(rows, np.int64)
    full = index.filter(F.size("terms") > 0)
    sample = full if count <= SEEDS else full.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < int(SEEDS / count * (1 << 30)))

    def emit(best: Best) -> Iterator[pa.RecordBatch]:
        held = [(i, *x) for i, x in enumerate(best.found) if len(x[0])]
        for part in iter(lambda it=iter(held): list(islice(it, 10_000)), []):
            item = np.repeat(numbers[[i for i, *_ in part]], [len(s) for _, s, _, _ in part])
            scores, ids, missing = (np.concatenate(x) for x in zip(*(x[1:] for x in part), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=missing), pa.array(scores)], ["row", "doc_id", "score"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = Best(len(numbers), items.bounds)
        for ids, missing, sizes, terms, x in read(batches, total, count):
            for k, start in enumerate((np.cumsum(sizes) - sizes).tolist()):
                scores = items.scores(terms[start : start + sizes[k]], x[start : start + sizes[k]])
                for i in np.flatnonzero((scores >= best.bounds) & (scores > 0)).tolist():
                    best.add(i, scores[i : i + 1], ids[k : k + 1], missing[k : k + 1])
        yield from emit(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(search_part(read(batches, total, count), shared.value))

    schema = "row long, doc_id long, score long"
    shared = spark.sparkContext.broadcast(Items(lists, weight, np.zeros(len(rows), np.int64)))
    tenth = sample.mapInArrow(seed, schema).withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).filter(F.col("k") == BEST)
    reached = {r["row"]: r["score"] for r in tenth.toLocalIterator()}
    bounds = np.array([reached.get(r, 0) for r in rows], np.int64)
    shared = spark.sparkContext.broadcast(Items(lists, weight, bounds))
    return full.mapInArrow(run, schema)


#: The same in SQL over ``documents`` and ``benchmark``.
SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
weighted AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weighted USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
