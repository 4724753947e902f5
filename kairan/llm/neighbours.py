"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and indexes every vector by its leaf; each node then knows the number and the
mean of all vectors below it. A query keeps the branches in a priority queue, by the cosine that the best vector below
a branch can be expected to have, and visits leaves in that order; the share of vectors that it visits is widened until
a calibration against brute force, on vectors that the tree wasn't fitted on, reaches the wanted recall, and on until
the leaves visited hold enough vectors. Visited leaves are then searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, release, stored

#: Vectors that fitting and calibration read, about, at most, chosen by hash.
FIT_VECTORS = 50_000
#: Branches a node; rounds of k-means a node; vectors a leaf, and vectors of the sample a leaf at least.
BRANCHES, ROUNDS, LEAF, LEAST_LEAF = 16, 8, 32, 4
#: Recall that calibration demands on its queries, and their number.
RECALL, CALIBRATION_QUERIES = 0.94, 400
#: Neighbouring leaves are searched together, in bundles of about ``BLOCK`` vectors (``LEAST_BUNDLES`` at least); a bundle
#: that holds more is dealt to several tasks, and so are more queries than ``QUERY_BLOCK``.
BLOCK, LEAST_BUNDLES, QUERY_BLOCK = 4096, 16, 16_384


class Tree:
    """Spherical k-means: centres and children of all nodes (a leaf has none), with the vectors' mean and number."""

    def __init__(self, vectors: np.ndarray, leaf: int, seed: int = 3):
        self.children: list[tuple[np.ndarray, list[int]]] = []  # unit centres, node numbers
        self.leaves: list[int] = []
        self._grow(vectors, leaf, np.random.default_rng(seed))
        self.number = {node: i for i, node in enumerate(self.leaves)}
        of = self.assign(vectors)
        sums = np.zeros((len(self.leaves), vectors.shape[1]))
        np.add.at(sums, of, vectors)
        self.load(np.bincount(of, minlength=len(self.leaves)), sums)

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        self.children.append((np.empty((0, x.shape[1])), []))
        if len(x) > leaf:
            centres = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)].copy()
            for _ in range(ROUNDS):
                of = (x @ centres.T).argmax(1)
                for k in range(len(centres)):
                    if (of == k).any():
                        mean = x[of == k].mean(0)
                        centres[k] = mean / max(float(np.linalg.norm(mean)), 1e-12)
            of = (x @ centres.T).argmax(1)
            used = np.unique(of)
            if len(used) > 1:
                self.children[node] = (centres[used], [self._grow(x[of == k], leaf, rng) for k in used])
                return node
        self.leaves.append(node)
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector: nearest centre at every level."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, mine = todo.pop()
            centres, below = self.children[node]
            if not below:
                out[mine] = self.number[node]
                continue
            of = (x[mine] @ centres.T).argmax(1)
            todo += [(child, mine[of == k]) for k, child in enumerate(below) if (of == k).any()]
        return out

    def load(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Numbers and sums of the leaves' vectors; nodes get their means and the spread around them."""
        total, whole = np.zeros(len(self.children)), np.zeros((len(self.children), sums.shape[1]))
        total[self.leaves], whole[self.leaves] = counts, sums
        for node in reversed(range(len(self.children))):  # children come after their parents
            below = self.children[node][1]
            if below:
                total[node], whole[node] = total[below].sum(), whole[below].sum(0)
        self.counts, self.means = total, whole / np.maximum(total, 1)[:, None]
        spread = np.sqrt(np.maximum(0.0, 1 - (self.means**2).sum(1)))
        self.slack = spread * np.sqrt(2 * np.log(np.maximum(total, 2)) / sums.shape[1])

    def expected(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the cosine that the best of the node's vectors can be expected to have."""
        return queries @ self.means.T + self.slack

    def visit(self, row: np.ndarray, share: float, least: int) -> list[int]:
        """Leaf numbers in best-bin-first order until they hold ``share`` of all vectors, and ``least`` vectors."""
        row, enough, seen, out = row.tolist(), max(share * self.counts[0], min(least, self.counts[0])), 0.0, []
        queue: list[tuple[float, int, int, list[int]]] = [(-row[0], 0, 0, [0])]  # the best branch of each opened node
        while queue and seen < enough:
            _, node, k, siblings = heapq.heappop(queue)
            if k + 1 < len(siblings):
                heapq.heappush(queue, (-row[siblings[k + 1]], siblings[k + 1], k + 1, siblings))
            below = self.children[node][1]
            if below:
                order = sorted(below, key=lambda n: -row[n])
                heapq.heappush(queue, (-row[order[0]], order[0], 0, order))
            else:
                out.append(self.number[node])
                seen += self.counts[node]
        return out


def calibrated(tree: Tree, sample: np.ndarray, queries: np.ndarray, k: int, recall: float) -> float:
    """Share of the vectors to visit: widened until ``recall`` of the queries' true ``k`` nearest of the sample are visited."""
    of, needed = tree.assign(sample), []
    sizes = tree.counts[tree.leaves]
    for q, row in zip(queries, tree.expected(queries), strict=True):
        near = np.argpartition(-(sample @ q), min(k, len(sample)) - 1)[:k]
        order = np.array(tree.visit(row, 1.0, 0))
        at = np.full(len(sizes), len(order))
        at[order] = np.arange(len(order))
        share = np.append(np.cumsum(sizes[order]) / max(1.0, tree.counts[0]), 1.0)
        needed += share[at[of[near]]].tolist()
    return float(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """A column of ``n`` lists of equal lengths as a matrix of doubles."""
    return np.asarray(column.flatten()).reshape(n, -1).astype(np.float64)


def cosine_rows(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, in double precision; each row's value depends on that row alone."""
    return (q * v).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum(1)))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = FIT_VECTORS) -> DataFrame:
    """``query_id`` long, ``rank`` int (from 1), ``vec_id`` long, ``score`` double: each query's ``k`` nearest by cosine.

    ``is_query`` is a condition on the id; candidates are all rows but the query's own id. Ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id;
    nor do vectors whose length isn't the most common one, for no cosine is defined between lengths. Every query gets
    ``k`` neighbours, or all candidates if there are fewer. Equal vectors are one point of the index that carries its
    ``k`` + 1 least ids, for more can't be among anyone's ``k`` nearest; so copies cost nothing. Rows that repeat id and
    vector count once. Other columns aren't read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    whole = whole.filter("id is not null and v is not null").filter(fine)
    usual = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    zero = F.lit(0).cast(dict(whole.dtypes)["v"][6:-1])
    same = whole.filter(F.size("v") == usual["n"]).withColumn("v", F.transform("v", lambda x: x + zero))  # -0.0 is 0.0
    points = same.select("id", "v", F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit("vector"), "v"))).alias("key"))
    # the k + 1 least ids of each distinct vector: tasks keep so many each before they meet
    ranked = points.dropDuplicates(["key", "id"]).selectExpr("key", "id", "v", "row_number() over (partition by key order by id) as n").filter(F.col("n") <= k + 1)
    index = stored(ranked.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "index")
    total = index.count()
    picked = hash_sample(index, F.col("key"), sample).select("v").toArrow()["v"].combine_chunks()
    if not len(picked):
        picked = index.limit(sample).select("v").toArrow()["v"].combine_chunks()
    units = _unit(_rows(picked, len(picked)))
    asking = min(CALIBRATION_QUERIES, len(units) // 10)
    tree = Tree(units[asking:], max(LEAST_LEAF, LEAF * len(units) // total))
    grown = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = grown.value.assign(_unit(_rows(batch.column(2), batch.num_rows))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.int64())], ["key", "ids", "v", "leaf"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(grown.value.leaves), np.int64), np.zeros((len(grown.value.leaves), usual["n"]))
        for batch in batches:
            of = batch.column(1).to_numpy()
            counts += np.bincount(of, minlength=len(counts))
            np.add.at(sums, of, _unit(_rows(batch.column(0), batch.num_rows)) if batch.num_rows else 0)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.float64()))], ["leaf", "n", "sums"])

    kinds = f"key string, ids array<long>, v {dict(index.dtypes)['v']}"
    placed = stored(index.select("key", "ids", "v").mapInArrow(assign, f"{kinds}, leaf long"), "leaves")
    release(index)
    parts_ = placed.select("v", "leaf").mapInArrow(add_up, "leaf long, n long, sums array<double>")
    leaf_sums = parts_.groupBy("leaf").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(usual["n"]))).alias("sums")).toArrow()
    counts, sums, at = np.zeros(len(tree.leaves), np.int64), np.zeros((len(tree.leaves), usual["n"])), leaf_sums["leaf"].to_numpy()
    counts[at], sums[at] = leaf_sums["n"].to_numpy(), _rows(leaf_sums["sums"].combine_chunks(), len(at))
    tree.load(counts, sums)
    share = calibrated(tree, units[asking:], units[:asking], k, recall) if asking else 1.0
    # leaves in order make bundles of about equal numbers of vectors
    bundles = max(LEAST_BUNDLES, -(-total // BLOCK))
    bundle_of = (np.cumsum(counts) - counts) * bundles // max(1, total)
    blocks_of = -(-np.bincount(bundle_of, counts, bundles).astype(np.int64) // (2 * BLOCK))
    shared = spark.sparkContext.broadcast((tree, share, bundle_of))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, most, bundle = shared.value
        kind = pa.list_(pa.struct([("bundle", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, ways = batch.slice(start, 256), []
                for row in full.expected(_unit(_rows(part.column(1), part.num_rows))):
                    found: dict[int, list[int]] = {}
                    for leaf in full.visit(row, most, k + 1):
                        found.setdefault(int(bundle[leaf]), []).append(leaf)
                    ways.append([{"bundle": b, "leaves": x} for b, x in found.items()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ways, kind)], ["key", "v", "ways"])

    asked = points.filter(is_query(F.col("id"))).select("id", "key").distinct()
    queries = placed.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v").mapInArrow(walk, f"key string, v {dict(index.dtypes)['v']}, ways array<struct<bundle:long,leaves:array<long>>>")
    queries = stored(queries, "walks")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at_block = lambda n: F.pmod(F.xxhash64("key"), n)
    blocks = spark.createDataFrame(pd.DataFrame({"bundle": np.arange(bundles), "blocks": np.maximum(1, blocks_of)}))
    leaf_bundles = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(tree.leaves)), "bundle": bundle_of}))
    visited = queries.withColumns({"w": F.explode("ways"), "turn": at_block(F.lit(query_blocks))}).select(F.col("key").alias("q_key"), F.col("v").alias("q"), "turn", "w.bundle", "w.leaves").join(F.broadcast(blocks), "bundle")
    visited = visited.withColumn("block", spread(F.col("blocks"))).drop("blocks")
    held = placed.join(F.broadcast(leaf_bundles), "leaf").join(F.broadcast(blocks), "bundle").withColumn("block", at_block(F.col("blocks"))).select("bundle", "block", "leaf", "ids", "v", spread(F.lit(query_blocks).cast("long")).alias("turn"))
    number = len(tree.leaves)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q_key": [], "score": [], "ids": []}, dtype=object)
        v, ids, out = np.stack(right["v"].to_numpy()).astype(np.float64), right["ids"].tolist(), []
        first, unit, all_q, leaf = np.array([x[0] for x in ids]), _unit(v), np.stack(left["q"].to_numpy()).astype(np.float64), right["leaf"].to_numpy()
        for at in range(0, len(all_q), 256):
            rough = all_q[at : at + 256] @ unit.T
            for row, key, q, seen in zip(rough, left["q_key"].iloc[at : at + 256], all_q[at : at + 256], left["leaves"].iloc[at : at + 256], strict=True):
                visited_here = np.zeros(number, bool)
                visited_here[seen] = True
                mine = np.flatnonzero(visited_here[leaf])
                near = mine[np.argpartition(-row[mine], min(k + 8, len(mine) - 1))[: k + 9]] if len(mine) else mine
                s = cosine_rows(q, v[near])  # the exact measure, whose last bits a matrix product needn't give
                best = np.lexsort((first[near], -s))[: k + 1]
                out += [(key, float(s[i]), ids[near[i]]) for i in best]
        return pd.DataFrame(out, columns=["q_key", "score", "ids"], dtype=None if out else object)

    by = ("bundle", "block", "turn")
    found = visited.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(search, "q_key string, score double, ids array<long>")
    # a query's own vector and k others hold its k nearest
    short = found.selectExpr("q_key", "score", "ids", "row_number() over (partition by q_key order by score desc, ids[0]) as n").filter(F.col("n") <= k + 1)
    lists = short.groupBy("q_key").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    each = asked.join(lists, asked["key"] == lists["q_key"]).select(F.col("id").alias("query_id"), F.explode("near").alias("p")).select("query_id", F.col("p.score").alias("score"), F.explode("p.ids").alias("vec_id")).filter("query_id <> vec_id")
    best = each.selectExpr("query_id", "vec_id", "score", "row_number() over (partition by query_id order by score desc, vec_id) as rank").filter(F.col("rank") <= k)
    return best.selectExpr("query_id", "cast(rank as int) as rank", "vec_id", "score")
