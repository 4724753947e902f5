"""Small cases that queries once failed on, or that show how their work grows."""

import duckdb

from kairan.plans.queries import ORACLE_SQL, QUERIES


def test_resolved_people_rounds_halves_as_sql_does(spark, tmp_path):
    """0.5 and 0 are one reading, 1.5 and 2 another: halves go to the even number."""
    rows = [(i, f"C{i}", i // 6, b) for i, b in enumerate([9.0, 0.5, 0.0, 0.0, 1.5, 2.0, 2.5, 2.0, 2.0, 3.5, -0.5, 0.0, -1.5, -2.0, 4.0, 2.5, 3.0, 3.5])]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    found = {tuple(r) for r in QUERIES["resolved_people"](spark, str(tmp_path)).select("c_custkey", "resolved_by").collect()}
    assert found == set(con.execute(ORACLE_SQL["resolved_people"]).fetchall())
    assert {k for _, k in found} == {"name", "kana", "none"}


def test_stream_calls_python_once_for_many_items():
    """A part's items are applied in one call, each to its own state."""
    import pandas as pd

    from kairan.streaming.review import _KEPT, _Memory

    held = {}

    class States:
        getValue, updateValue = staticmethod(held.get), staticmethod(held.__setitem__)  # noqa: N815

    class Handle:
        getMapState = staticmethod(lambda *_: States)  # noqa: N815

    part = _Memory(None)
    part.init(Handle)
    names = ["user_id", "mode", "target", "id", "at", "seq", "grade"]
    start = dict.fromkeys(_KEPT, 0) | {"stability": 2.0, "difficulty": 5.0, "updated_at": 50, "last_seq": 1, "reps": 3, "last_grade": "good", "status": "learning", "in_wrong": True}
    part.handleInitialState((7,), pd.DataFrame([{"user_id": 1, "mode": "m", "target": "t", "id": 2} | start]), None)
    rows = [(1, "m", "t", 2, 40, 0, "again"), (1, "m", "t", 1, 100, 1, "again"), (1, "m", "t", 2, 60, 2, "good"), (1, "m", "t", 1, 90, 0, "good")]
    out = pd.concat(part.handleInputRows((7,), iter([pd.DataFrame(rows[:2], columns=names), pd.DataFrame(rows[2:], columns=names)]), None))
    assert out[["id", "reps", "applied", "dropped", "in_wrong"]].values.tolist() == [[1, 0, 2, 0, True], [2, 4, 1, 1, True]]
    assert out["changes"].tolist() == [[(100, 1, "wrong", "added")], []]
    assert sorted(held) == [(1, "m", "t", 1), (1, "m", "t", 2)]


def test_texts_are_searched_for_all_lengths_at_once(monkeypatch):
    """Names of 120 lengths cost a text no more look-ups than names of one length a power of two; none is lost."""
    import numpy as np

    from kairan.operators import containing

    text = "".join(chr(97 + i * i * 7 % 26) + chr(97 + i * 5 % 23) for i in range(600))
    names = {text[3 * x : 3 * x + x] for x in range(1, 121)} | {text[-n:] for n in (1, 64, 120)} | {text[40:100] + "?"}
    filters = np.full((2, containing.ROW_BITS // 8), 0, np.uint8)
    for name in names:
        for filter_, hashes in zip(filters, containing._name_hashes(name)[1:], strict=True):
            for place in np.concatenate(containing._places(hashes, containing.ROW_BITS)):
                filter_[place >> 3] |= 1 << (place & 7)
    finder = containing.Finder(filters[0], filters[1], sorted({len(n) for n in names}))
    calls, passed = [], containing.Finder.passed
    monkeypatch.setattr(containing.Finder, "passed", lambda *a: calls.append(1) or passed(*a))
    for pairs in (1 << 20, 1):
        monkeypatch.setattr(containing, "PAIRS", pairs, raising=False)
        assert names & finder.candidates(text) == {n for n in names if n in text}
        assert pairs == 1 or len(calls) <= 2 * 7


def test_small_ranges_share_tasks(spark, tmp_path):
    """Tasks follow the bytes, not the number of ranges; a range reads on by its own length, so results stay whole."""
    from kairan.sources import ranges

    items = [f'{{"n": "{"x" * (i % 90)}"}}' for i in range(400)]
    (tmp_path / "a.json").write_text(f"[{','.join(items)}]")
    assert ranges._ranges(spark, str(tmp_path), 16).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    rows = ranges.read_elements(spark, str(tmp_path), "[", 16).selectExpr("ord", "length(variant_get(v, '$.n', 'string')) as n").collect()
    assert sorted((r["ord"], r["n"]) for r in rows) == [(i, i % 90) for i in range(400)]


def test_derived_files_hold_a_thousand_people(spark, tmp_path):
    from kairan.plans import queries

    people = spark.range(50_000).selectExpr("id as c_custkey", "concat('C', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'M' as c_mktsegment")
    people.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert queries._json_lines(spark, str(tmp_path)).count() == 50


def test_orders_by_placed_names_compare_no_names(spark):
    """Orders that go by names' places are those that go by names; only name orders and districts compare texts."""
    from pyspark.sql import functions as F

    from kairan.operators import ranking

    rows = spark.range(60).selectExpr("id", "concat('ナ', id % 7) as name", "case when id % 3 = 0 then ' ' else concat('か', id % 5) end as kana", "concat('d', id % 4) as district", "case when id % 6 > 0 then id % 4 end as terms", "case when id % 5 > 0 then id % 3 end as next_election_year")
    placed = ranking.ranked(rows, [], ranking.roster_order("name_asc"), "p")
    for key in ("name_desc", "district", "terms_asc", "terms_desc", "year_asc", "year_desc"):
        order = ranking.roster_order(key, "p")
        assert [r["id"] for r in placed.orderBy(*order).collect()] == [r["id"] for r in ranking.sort_roster(rows, key).collect()]
        assert key in ("name_desc", "district") or "collat" not in placed.orderBy(*order)._jdf.queryExecution().logical().toString().split("\n")[0].lower()
    assert placed.filter(F.col("p") == 1).first()["id"] == ranking.sort_roster(rows, "name_asc").first()["id"]


def test_stream_reads_and_writes_blocks_of_items(monkeypatch):
    """A deck costs a call to the state store a block, not an item; blocks are split, and states are those kept item by item."""
    import random

    import pandas as pd

    from kairan.streaming import review

    monkeypatch.setattr(review, "BLOCK", 64)
    calls, helds = [], []

    def handle():
        held = {}
        helds.append(held)

        class States:
            getValue = staticmethod(lambda k: calls.append(k) or held.get(k))  # noqa: N815
            updateValue = staticmethod(lambda k, v: calls.append(k) or held.__setitem__(k, v))  # noqa: N815

        class Handle:
            getMapState = staticmethod(lambda *_: States)  # noqa: N815

        return Handle

    rng, names = random.Random(3), ["user_id", "mode", "target", "id", "at", "seq", "grade"]
    batches = [pd.DataFrame([(u, "m", "t", rng.randrange(n) * 8, b * 10_000_000 + rng.randrange(90_000_000), b * 9_999 + i, rng.choice(["good", "again", "hard"])) for u, n in ((1, 10), (2, 400)) for i in range(12 if u == 1 else 600)], columns=names) for b in range(3)]
    told, costs = [], []
    for part in (review._Memory(None), review._Decks()):
        part.init(handle())
        calls.clear()
        told.append([pd.concat(part.handleInputRows((0,), iter([b]), None)).values.tolist() for b in batches])
        costs.append(len(calls))
    assert told[0] == told[1]
    assert costs[1] < costs[0] / 3
    assert max(len(v[0].split("], [")) for v in helds[1].values() if v[0]) <= 65 and sum(1 for k in helds[1] if k[0] == 1) == 1


def test_trimming_looks_at_ends_only(spark):
    """Outer white space is cut without a pattern that is tried at each character; the texts are those that a pattern gives."""
    from pyspark.sql import functions as F

    from kairan.functions import text

    odd = [None, "", text.SPACES, "a", f"{text.SPACES}a{text.SPACES}b{text.SPACES}", "\u200b x\u3000\ufeff", "\u0085y\x1f", "𠮷 \u2003", "x" * 9 + "\n"]
    rows = spark.createDataFrame([(x,) for x in odd], "s string")
    plain = lambda c: F.regexp_replace(c, f"^[{text.SPACE}]+|[{text.SPACE}]+$", "")
    s = F.coalesce("s", F.lit(""))
    found = rows.select(text.trimmed(F.col("s")).alias("a"), plain(s).alias("b"), text.squeezed(F.col("s")).alias("c"), plain(F.regexp_replace(s, f"[{text.SPACE}]+", " ")).alias("d"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in found.collect())
    assert "regexp" not in rows.select(text.trimmed(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()


def test_network_shifts_logits_only_where_it_must():
    """Log probabilities of mild and extreme logits are those of a softmax in double precision."""
    import numpy as np

    from kairan.llm import language_model

    lex = language_model.Lexicon([(f"w{i}".encode(), 100 - i) for i in range(60)], 10, 5000, 90)
    states, targets = np.random.default_rng(5).standard_normal((200, 16)).astype(np.float32), np.arange(200) % (lex.rare + 1)
    for scale in (1, 500):
        net = language_model.Network(lex)
        net.p["c"] *= scale
        net.p["w"] *= scale
        mild = states @ net.p["c"] + net.p["cb"]
        assert (language_model._safe(mild.copy()) == mild).all() == (scale == 1)
        soft = lambda x: x - x.max(1, keepdims=True) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True))
        of = lex.of[targets]
        want = soft(mild.astype(float))[np.arange(200), of] / np.log(10) + lex.within[targets]
        for i in np.flatnonzero(of < lex.head_classes):
            words = soft((states[i : i + 1] @ net.p["w"][of[i]] + net.p["wb"][of[i]]).astype(float))
            want[i] += words[0, targets[i] - of[i] * language_model.CLASS_WORDS] / np.log(10)
        assert np.allclose(net.log10(states, targets, lex), want, rtol=1e-4, atol=1e-4)
