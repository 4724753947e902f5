"""Near-duplicate documents by circulant MinHash.

Two permutations serve for all signature coordinates (Li and Li 2021): the first scatters the shingles, the second,
shifted circularly by k places, gives coordinate k as the least value at the shingles' places. Bands of coordinates
propose pairs; exact Jaccard similarity of the full shingle sets confirms them; links join into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, release, stored, text_slices, word_parts
from .components import components

#: Words a shingle, and percent of shared shingles from which texts are near-duplicates.
WIDTH, PERCENT = 5, 80
#: Places of the permutations; coordinates a band; bands. At 80 % a pair is missed with probability 5e-6.
PLACES, ROWS, BANDS = 1 << 20, 6, 40
#: Rounds at most that propose two pairs a document and bucket before what is left is compared in full; the nodes whose
#: numbers are least after these exclusive-ors lead their bucket (the least and the greatest, then two between).
LEADS = ((0, (1 << 62) - 1), (0x1555555555555555, 0x2AAAAAAAAAAAAAAA))
#: All pairs of buckets up to this size are joined; larger buckets are compared in blocks of about so many nodes and bytes.
SMALL_BUCKET, BLOCK, BLOCK_BYTES = 64, 1024, 16_000_000
#: Buckets with over this share of all places are hot; there are fewer than its inverse of them, so that they can be listed.
HOT_SHARE = 1 / 1000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width, self.known = width, Cache(xxhash.xxh64_intdigest)

    def shingles(self, raw: bytes | None) -> np.ndarray:
        get = self.known.__getitem__
        parts = [np.fromiter(map(get, found), np.uint64, len(found)) for found in word_parts(raw)]
        if not parts:
            return np.empty(0, np.uint64)
        h = np.concatenate(parts)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)  # a shorter sequence never equals a full shingle
        for i in range(width):
            out = _mixed(out * _MIX + h[i : len(h) - width + 1 + i])
        return np.unique(out)


class Signer:
    """Band keys of shingle sets."""

    def __init__(self):
        rng = np.random.default_rng(20)
        self.scatter = rng.permutation(PLACES).astype(np.int32)
        values = rng.permutation(PLACES).astype(np.int32)
        self.shifted = sliding_window_view(np.concatenate([values, values[: ROWS * BANDS - 1]]), ROWS * BANDS)
        self.salt = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles & np.uint64(PLACES - 1)).astype(np.int64)]
        out = np.full(ROWS * BANDS, PLACES, np.int32)
        for at in range(0, len(places), 2048):  # a shift by k is the k-th column of one contiguous row
            np.minimum(out, self.shifted[places[at : at + 2048]].min(0), out=out)
        return out

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; equal keys in different bands differ by their salt."""
        parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(self.salt, parts.shape[:2])
        for i in range(ROWS):
            key = _mixed(key * _MIX + parts[:, :, i])
        return key.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (128 bits of the set; null if empty) and ``bands`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(width), Signer()
        for part in text_slices(batches, 1):
            sizes, keys, signatures = [], [], []
            for raw in part.column(1).cast(pa.binary()):
                x = shingler.shingles(raw.as_py())
                sizes.append(len(x))
                keys.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
                signatures.append(signer.signature(x))
            bands = signer.bands(np.stack(signatures))
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return base.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``node`` and ``items`` (its sorted shingle hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for part in text_slices(batches, 1):
            items = [shingler.shingles(raw.as_py()).tobytes() for raw in part.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node long, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets reach ``percent``: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _with_bucket(places: DataFrame, buckets: DataFrame) -> DataFrame:
    """``places`` joined with ``buckets`` (stored; one row a ``bucket``, with its number of places ``n``).

    A hot bucket's places would all meet in one task: such buckets' rows, fewer than ``1 / HOT_SHARE``, go to the
    places instead.
    """
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in buckets.filter(F.col("n") > total * HOT_SHARE).select("bucket").collect()]
    if not hot:
        return places.join(buckets, "bucket")
    often = F.col("bucket").isin(hot)
    return places.filter(~often).join(buckets.filter(~often), "bucket").unionByName(places.filter(often).join(F.broadcast(buckets.filter(often)), "bucket"))


def _small_pairs(places: DataFrame, large: DataFrame) -> DataFrame:
    """All pairs of different components in buckets that aren't ``large``."""
    small = places.join(large.select("bucket"), "bucket", "left_anti")
    left = small.select("bucket", F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("component").alias("ca"))
    right = small.select("bucket", F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"))
    return left.join(right, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))


def _large_links(places: DataFrame, large: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of different components in ``large`` buckets.

    ``large`` has ``bucket``, its nodes ``n`` and bytes of sets ``mass``, its largest component ``top`` and the nodes
    and bytes outside it, ``rest`` and ``rest_mass``. Nodes outside a bucket's largest component are compared with all
    its nodes, block by block, inside the tasks: no pair becomes a row, only links do, one a node and component. A pair
    that shares several buckets is compared in the first of its bands only. Blocks hold about ``BLOCK`` nodes and
    ``BLOCK_BYTES`` of sets at most, so a task's memory doesn't depend on the texts' lengths.
    """
    big = _with_bucket(places, large)
    dealt = lambda n, mass: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(mass) / BLOCK_BYTES))
    blocks, parts = dealt("n", "mass"), dealt("rest", "rest_mass")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at = lambda n: F.pmod(F.xxhash64("node"), n)
    members = big.select("bucket", "node", "component", at(blocks).alias("block"), span(parts).alias("part"), F.lit(False).alias("asks"))
    asking = big.filter("component <> top").select("bucket", "node", "component", span(blocks).alias("block"), at(parts).alias("part"), F.lit(True).alias("asks"))
    rows = members.unionByName(asking).join(bands, "node").join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, held = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(ask) or not len(held):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        bucket, keys = pdf["bucket"].iloc[0], np.stack(held["bands"].to_list())
        items = [np.frombuffer(x, np.uint64) for x in held["items"]]
        sizes, nodes, parts_ = np.fromiter(map(len, items), np.int64, len(items)), held["node"].to_numpy(), held["component"].to_numpy()
        out = []
        for node, part, own, raw in zip(ask["node"], ask["component"], ask["bands"], ask["items"], strict=True):
            mine = np.frombuffer(raw, np.uint64)
            same = keys == np.asarray(own)
            first = keys[np.arange(len(keys)), same.argmax(1)]
            fits = (sizes * 100 >= len(mine) * percent) & (len(mine) * 100 >= sizes * percent)
            near = np.flatnonzero(same.any(1) & (first == bucket) & (parts_ != part) & fits)
            if not len(near):
                continue
            joined = np.concatenate([items[i] for i in near])
            hit = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
            shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            good = near[100 * shared >= percent * (sizes[near] + len(mine) - shared)]
            for i in {parts_[i]: i for i in good}.values():
                out.append((min(node, nodes[i]), max(node, nodes[i])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "block", "part").applyInPandas(compare, "a long, b long").distinct()


def _sizes(places: DataFrame) -> DataFrame:
    """Of each bucket of several components: nodes and bytes of all, of the largest component, and of the others."""
    parts = places.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("m")).groupBy("bucket")
    whole = parts.agg(F.sum("c").alias("n"), (8 * F.sum("m")).alias("mass"), F.max_by("component", "c").alias("top"), (F.sum("c") - F.max("c")).alias("rest"), (8 * (F.sum("m") - F.max_by("m", "c"))).alias("rest_mass"))
    return whole.filter("rest > 0")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least doc_id reachable, itself included), ``kept`` (is that one).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words than ``width`` is one shingle; a
    null or empty text has none and links with nothing. Equal sets are one node from the start, so copies are never
    paired. Within a bucket each node is compared with two leads a round; buckets whose nodes have all come together
    are done; in the last round the pairs of different components that a bucket still holds are all compared, so
    no proposed link between different texts is lost. Ids are taken to be unique: rows that repeat one get an answer
    each; a null doc_id links with nothing (component null, kept true). Other columns aren't read.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    made: list[DataFrame] = []  # tables that the answer doesn't read

    def hold(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    sketch = stored(sketches(base, width), "sketch")
    usable = sketch.filter("set_key is not null and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = hold(usable.join(classes.select("node", F.col("set_key").alias("key")), (F.col("doc_id") == F.col("node")) & (F.col("set_key") == F.col("key"))).select("node", "n_shingles", "bands"), "nodes")
    places = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = hold(places.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    held = hold(_with_bucket(places, shared).select("bucket", "node", "n_shingles", F.col("node").alias("component")), "buckets")
    wanted = held.select("node").distinct()
    mine = base.join(wanted, base["doc_id"] == wanted["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = labels = tried = None
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    for turn, masks in enumerate([*LEADS, ()]):
        sizes = hold(_sizes(held), "sizes")
        if sizes.isEmpty():
            break
        if turn:
            held = hold(_with_bucket(held, sizes.select("bucket", "n")).drop("n"), "open")
        large = sizes.filter(F.col("n") > SMALL_BUCKET)
        last = not masks or large.isEmpty()
        if last:
            pairs = _small_pairs(held, large)
        else:
            ends = [F.min(F.col("node").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in masks]
            leads = hold(held.groupBy("bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array(*ends)).alias("leads")), "leads")
            met = _with_bucket(held, leads).select("node", "n_shingles", "component", F.explode("leads").alias("lead")).filter("node <> lead")
            met = met.groupBy("node", "lead").agg(F.first("n_shingles").alias("na"), F.first("component").alias("ca"))
            led = held.select(F.col("node").alias("lead"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb")).distinct()
            pairs = met.join(led, "lead").filter("ca <> cb").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"), "na", "nb")
        pairs = pairs.filter(fits).select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = hold(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if sets is None:
            sets = hold(shingle_sets(mine, width).dropDuplicates(["node", "items"]), "sets")
        good = confirmed(pairs, sets, percent)
        if last and not large.isEmpty():
            good = good.union(_large_links(held, large, nodes.select("node", "bands"), sets, percent))
        good = hold(good, "links")
        if not good.isEmpty():
            known = good if labels is None else good.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b")))
            made += [labels] if labels is not None else []
            labels = stored(components(known), "labels")
            held = held.join(labels.select("node", F.col("component").alias("found")), "node", "left").withColumn("component", F.coalesce("found", "component")).drop("found")
        if last:
            break
    release(*made)
    whole = classes.withColumn("component_id", F.col("node"))
    if labels is not None:
        whole = classes.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    answer = sketch.select("doc_id", "n_shingles", "set_key").join(whole.select("set_key", "component_id"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
