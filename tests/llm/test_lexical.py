"""Ranked lexical search against a plain version."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairan.llm import lexical

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def placed(row):
    return tuple((x is None, x or 0) for x in row)


def plain_search(docs, items):
    """Every document scored for every item."""
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    count, total = len(found), sum(n for _, _, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked, scored = set(terms(text)), []
        for doc, c, n in found:
            m = 100 - 90 + (90 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:10])]
    return sorted(out, key=placed)


def prose(rng, n, words):
    return " ".join(rng.choice(words[: rng.choice([5, 30, len(words)])]) + rng.choice(["", "", ",", ".", "-x", "é"]) for _ in range(n))


def tables(spark, texts, items, clash=False):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    if clash:
        docs = docs.withColumns({n: F.lit("c") for n in ("terms", "tf", "n", "row", "score", "item_id")})
        asked = asked.withColumns({n: F.lit("c") for n in ("terms", "row", "doc_id", "rank", "score")})
    return docs, asked


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=placed)


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "Bc", "9", " ", "\n", "é", "É", "　", "\x1c", "\x7f", "@", "[", "`", "{", "_", "\x00", "日"]) for _ in range(rng.randint(0, 25)))
        assert [x.decode() for part in lexical.term_lists(t.encode()) for x in part] == terms(t)


@pytest.mark.parametrize("long,pass_terms", [(1024, 10**6), (6, 40)])
def test_search_equals_brute_force(spark, monkeypatch, long, pass_terms):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(250)]
    texts = [(i, prose(rng, rng.choice([1, 5, 40, 200]), words)) for i in range(300)]
    texts += [(400 + i, texts[7][1]) for i in range(30)] + [(7, texts[7][1]), (None, texts[7][1]), (None, texts[8][1]), (900, None), (901, ""), (902, "-- !"), (903, "z" * 5000 + " a"), (904, prose(rng, 9000, words))]
    items = [(i, prose(rng, rng.choice([1, 6, 25]), words)) for i in range(25)] + [(50, None), (51, ""), (52, "unseen-unheard"), (53, texts[7][1]), (53, texts[8][1])]
    docs, asked = tables(spark, texts, items, clash=True)
    monkeypatch.setattr(lexical, "SEEDS", 60)
    rows = got(lexical.search(docs.repartition(4), asked, pass_terms=pass_terms))
    assert rows == plain_search(texts, items)


@pytest.mark.parametrize("sizes", [(4096, 200_000, 1024, 32, 2_000_000), (50, 2000, 30, 4, 300), (1, 10, 1024, 32, 1)])
def test_blocks_lose_nothing(monkeypatch, sizes):
    for name, value in zip(("CHUNK", "PLACES", "LONG", "BLOCK", "MERGED"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(3)
    n_terms, scored, all_docs = 300, 0, 0
    weight = rng.integers(0, 9000, n_terms)
    lists = [np.unique((n_terms * rng.random(rng.integers(1, 20)) ** 2).astype(np.int64)) for _ in range(20)]
    parts = []
    for p in range(4):
        own = [np.unique((n_terms * rng.random(rng.integers(1, 60)) ** 3).astype(np.int64)) for _ in range(70)]
        counts = np.array([len(x) for x in own])
        parts.append((np.arange(70) + 100 * p, np.zeros(70, bool), counts, np.concatenate(own), rng.integers(1, 1_000_000, counts.sum()) // 250_000 * 250_000 + 5))
    items = lexical.Items(lists, weight, np.zeros(20, np.int64))
    best = lexical.search_part(iter(parts), items)
    for i in range(20):
        want = []
        for ids, _, counts, t, x in parts:
            for k, at in enumerate(np.cumsum(counts) - counts):
                own = dict(zip(t[at : at + counts[k]].tolist(), x[at : at + counts[k]].tolist(), strict=True))
                if (s := sum(int(weight[j]) * own.get(j, 0) for j in lists[i].tolist())) > 0:
                    want.append((-s, int(ids[k])))
        assert list(zip((-best.found[i][0]).tolist(), best.found[i][1].tolist(), strict=True)) == sorted(want)[:10]
    for part in parts:
        chunk = lexical.Chunk(*part, items)
        scored += chunk.search(best)
        all_docs += len(part[0]) * 20
    if sizes[3] < 32:
        assert scored < all_docs / 3  # with bounds that are known, most blocks are skipped


def test_summaries_are_the_greatest_scores():
    rng = np.random.default_rng(4)
    own = [np.unique(rng.integers(0, 40, 12)) for _ in range(200)]
    counts = np.array([len(x) for x in own])
    x = rng.integers(1, 1_000_000, counts.sum())
    chunk = lexical.Chunk(np.arange(200), np.zeros(200, bool), counts, np.concatenate(own), x, lexical.Items([np.arange(40)], np.ones(40, np.int64), np.zeros(1, np.int64)))
    starts = np.cumsum(counts) - counts
    n_blocks, seen = 0, collections.defaultdict(list)
    for lists, doc, block, summary in chunk.blocks(np.arange(len(chunk.listed))):
        for b, k in enumerate(lists.tolist()):
            docs = doc[block == b].tolist()
            seen[int(chunk.listed[k])] += docs
            want = {}
            for d in docs:
                for t, s in zip(own[d].tolist(), x[starts[d] : starts[d] + counts[d]].tolist(), strict=True):
                    want[t] = max(want.get(t, 0), s)
            mine = summary[summary >> 40 == b]
            assert dict(zip(((mine >> 20) & 0xFFFFF).tolist(), (mine & 0xFFFFF).tolist(), strict=True)) == want
            n_blocks += 1
    assert {t: sorted(d) for t, d in seen.items()} == {t: [d for d in range(200) if t in own[d]] for t in range(40)}
    assert n_blocks > 40


def test_search_of_odd_tables(spark):
    docs, asked = tables(spark, [(1, "one two"), (2, None)], [(1, "two"), (2, None)])
    assert got(lexical.search(docs, asked)) == plain_search([(1, "one two"), (2, None)], [(1, "two")])
    assert got(lexical.search(docs.limit(0), asked)) == [] == got(lexical.search(docs, asked.limit(0)))
    assert got(lexical.search(docs.filter("doc_id = 2"), asked)) == []


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9])
    assert lexical.lengths_of(n, 10**13, 10**10).tolist() == [10 + 90 * x * 10**10 // 10**13 for x in n.tolist()]
