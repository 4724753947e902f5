"""Packing and alignment of public tokenizers' tokens, against the libraries and plain versions."""

import collections
import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairan.llm import alignment, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
EDGES = [None, "", " ", "  \n ", "a", "one two", " lead", "trail ", "A" * 5000, "x " * 3000, "日本語 テキスト\n\n", "!!!", "<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "tab\there", "▁ under ▁x", "é́ ﬁ ½", "\x00 nul", "   many    spaces   ", "a b　c"]


def documents(spark, texts, clash=False):
    df = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns({n: F.lit("clash") for n in ("row", "pairs", "times", "piece", "part", "nth", "length", "n_a")}) if clash else df


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) + rng.choice(["", "", ".", ",\n", "'s", " 12", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(A)
    found.encode_special_tokens = True
    return found


def test_byte_level_equals_the_library(library):
    rng, quick = random.Random(3), tokens.byte_level(A, PATTERN, False)
    assert quick.quick is not None
    signs = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "22", "'s", "'ll", "-", "=", "日", "　", "\x1c", "\x85", "​", "🙂", "the", "ing", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        whole = library.encode(t, add_special_tokens=False).ids
        assert [x for p in tokens.text_parts(t, rng.randint(1, 12)) for x in quick.encode(p)] == whole
        assert b"".join(quick.bytes[i] for i in whole) == t.encode()
    default, special = Tokenizer.from_file(A), tokens.byte_level(A, PATTERN, True)
    for t in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "no", "<|endoftext"):
        assert special.encode(t).tolist() == default.encode(t, add_special_tokens=False).ids


def test_other_byte_level_files_use_their_library(tmp_path):
    spec = json.load(open(A, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][:-5][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    odd = tokens.ByteLevel(str(tmp_path / "odd.json"), PATTERN, False)
    assert odd.quick is None and odd.encode("hello there").tolist() == Tokenizer.from_file(str(tmp_path / "odd.json")).encode("hello there").ids


def test_parts_of_piece_texts():
    rng, piece = random.Random(4), tokens.piece_bpe(B)
    assert piece.cuts
    for _ in range(1000):
        t = "".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "▁", "12", "."]) for _ in range(rng.randint(1, 30)))
        parts = list(tokens.text_parts(" " + t, rng.randint(1, 9)))
        assert [x for n, p in enumerate(parts) for x in (piece.encode(p[1:], True) if n == 0 else piece.encode(p, False))] == piece.library.encode(t)


# ---- 13: packing
def test_plans_hold_every_piece_once():
    rng = random.Random(5)
    for _ in range(400):
        room = rng.choice([4, 8, 16, 64])
        counts = {rng.randint(1, room): rng.randint(1, 60) for _ in range(rng.randint(0, 14))}
        plan, got = packing.make_plan(counts, room, rng.choice([1, 3, 8])), collections.Counter()
        for n, lengths in plan.classes:
            assert n > 0 and sum(lengths) <= room
            got.update({x: n * k for x, k in collections.Counter(lengths).items()})
        assert got == counts
        plain = sum(n for n, _ in packing.best_fit(counts, [], room))
        assert plan.sequences <= plain * 1.1 + 3


def test_configurations_meet_the_optimum():
    # halves, thirds and what fills them up: the optimum leaves no room, best fit by length alone wastes much
    counts = {400: 600, 312: 600, 200: 1200, 112: 600, 513: 500, 511: 500}
    total = sum(k * v for k, v in counts.items())
    assert packing.make_plan(counts).sequences <= -(-total // 1024) * 1.01 + 6
    assert packing.knapsack(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.1]), 13)[0] == pytest.approx(14.0)
    value, taken = packing.knapsack(np.array([3, 5, 7]), np.array([1.0, 1.7, 2.5]), 13)
    assert value == pytest.approx(4.5) and taken.tolist() == [2, 0, 1]


def test_best_fit_equals_piece_by_piece():
    rng = random.Random(6)
    for _ in range(200):
        room = rng.randint(3, 40)
        counts = {rng.randint(1, room): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        bins = []
        for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fitting = [i for i, left in enumerate(bins) if left >= x]
            if fitting:
                bins[min(fitting, key=lambda i: bins[i])] -= x
            else:
                bins.append(room - x)
        got = packing.best_fit(counts, [], room)
        assert sorted(room - sum(x) for n, x in got for _ in range(n)) == sorted(bins)


def test_packing(spark):
    rng = random.Random(7)
    texts = EDGES + [prose(rng, rng.choice([1, 20, 150, 700, 3000])) for _ in range(60)]
    texts += texts[20:30]
    docs = documents(spark, texts, clash=True)
    docs = docs.union(docs.filter("doc_id = 5")).union(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(docs.repartition(5), A, PATTERN).collect()
    default, want = Tokenizer.from_file(A), collections.Counter()
    for doc, text in [*enumerate(texts), (5, texts[5]), (None, texts[6])]:
        ids = [*default.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) * 1.06 + 1


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), A, PATTERN).collect() == []
    assert [tuple(r)[1:4] for r in packing.pack(documents(spark, [None, None]), A, PATTERN).orderBy("doc_id").collect()] == [(0, 0, 1)] * 2


# ---- 11: alignment
def plain_alignment(texts):
    """Groups by bytes, links of all tokens of a group, counts in dictionaries."""
    library, piece = Tokenizer.from_file(A), tokens.piece_bpe(B)
    library.encode_special_tokens = True
    alphabet, vocabulary = tokens.byte_alphabet(), {i: k for k, i in library.get_vocab().items()}
    rows, seen = [], collections.Counter()
    for text in texts:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = piece.library.encode(text) if text else []
        raw_a, raw_b = [bytes(alphabet[c] for c in vocabulary[i]) for i in a], [piece.bytes[i] for i in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        seen.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(k for p, k in links.items() if seen[p] == best[p[0]]), sum(seen[p] * k for p, k in links.items()), hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 40, 0])
def test_alignment(spark, held):
    rng = random.Random(8)
    texts = EDGES + ["日本" * 50 + "🙂🙂" * 20, "\n \n\t " * 40, "=-" * 100] + [prose(rng, rng.choice([1, 20, 150])) for _ in range(25)]
    texts += texts[25:30]
    rows = alignment.align(documents(spark, texts, clash=True).repartition(3), A, PATTERN, B, held=held).orderBy("doc_id").collect()
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows] == plain_alignment(texts)


def test_alignment_in_parts(monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 400) for _ in range(6)] + ["x"]
    aligner, whole = alignment.Aligner(A, PATTERN, B), plain_alignment(texts)
    monkeypatch.setattr(alignment, "ALIGNED", 50)
    monkeypatch.setattr(tokens.text_parts, "__defaults__", (100,))
    assert len(list(aligner.tokens(texts[0]))) > 5
    rows = aligner.rows([*texts, texts[0] + " ▁ b", ""])
    assert [(*r[:4], r[4]) for r in rows] == [(*w[:4], w[6]) for w in whole] + [(0, 0, 0, 0, "")] * 2
    assert all(len(set(r[5].tolist())) == len(r[5]) and (r[6] > 0).all() for r in rows)


def test_groups_of_many_tokens():
    n = 4000  # one group of n tokens on either side: its ids count, not its pairs
    began = time.time()
    group_a, group_b, pairs = alignment.aligned(np.zeros(n, int), np.array([3] + [2] * (n - 2) + [1]), np.zeros(n, int), np.array([2] * n))
    assert not group_a.any() and not group_b.any() and len(pairs) == 2 * n - 1
    _, keys, times = alignment.link_counts(np.arange(n) % 3, group_a, np.arange(n) % 2, group_b, pairs)
    assert len(keys) == 6 and times.sum() == n * n and time.time() - began < 2


def test_alignment_of_odd_tables(spark):
    assert alignment.align(documents(spark, []), A, PATTERN, B).collect() == []
    docs = documents(spark, [None, "", "one"]).union(documents(spark, ["one"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = {r.doc_id: r for r in alignment.align(docs, A, PATTERN, B).collect()}
    assert rows[0].n_a == rows[1].n_links == 0 and rows[0].groups_sha256 == "" and rows[2].count_sum == rows[None].count_sum == 2
