import json
import random

import pytest
from pyspark.sql import functions as F

from kairan.operators import assets, diff, learning, linking, markup, quality, ranking, roster
from kairan.sources import files

PERSON = "target string, ord long, id long, name string, kana string, role string, party string, district string, terms int, image string, key string"


def person(i, name, party="A", image="", ord_=None):
    return ("t", ord_ if ord_ is not None else i, i, name, "", "", party, "", None, image, f"{i}:{name.replace(' ', '')}")


def test_diff_of_equal_snapshots_is_empty_and_sizes_add_up(spark):
    a = spark.createDataFrame([person(1, "a"), person(2, "b"), person(3, "c")], PERSON)
    b = spark.createDataFrame([person(1, "a", "B"), person(3, "c c"), person(4, "d")], PERSON)
    assert diff.diff_snapshots(a, a).count() == 0
    got = {r["key"]: (r["type"], r["fields"]) for r in diff.diff_snapshots(a, b).collect()}
    assert got == {"1:a": ("changed", ["party"]), "2:b": ("removed", []), "3:cc": ("added", []), "3:c": ("removed", []), "4:d": ("added", [])}


def test_diff_keeps_the_last_value_of_a_repeated_key(spark):
    a = spark.createDataFrame([person(1, "a")], PERSON)
    b = spark.createDataFrame([person(1, "a", "B", ord_=0), person(1, "a", "A", ord_=1)], PERSON)
    assert diff.diff_snapshots(a, b).count() == 0


def test_read_roster_and_normalize(spark, tmp_path):
    rows = [{"name": "山田 太郎（やまだ たろう）", "id": "7", "images": ["a.jpg", " "], "wins": 3}, None, {"name": "　"}, {"name": "B(b)", "image": "b.jpg", "group": "G", "id": 0}]
    (tmp_path / "r.json").write_text(json.dumps(rows), encoding="utf-8")
    got = [r.asDict() for r in roster.normalize_person(files.read_roster(spark, str(tmp_path / "r.json"), "senators")).orderBy("ord").collect()]
    assert [(g["id"], g["name"], g["kana"], g["party"], g["terms"], g["images"]) for g in got] == [(7, "山田 太郎", "やまだたろう", "", 3, ["a.jpg"]), (got[1]["ord"] + 1, "B", "b", "G", None, ["b.jpg"])]
    (tmp_path / "bad.json").write_text("{nope", encoding="utf-8")
    assert files.read_roster(spark, str(tmp_path / "bad.json"), "x").count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "pool.txt").write_text("https://a/x1_0.jpg\n\n https://a/x1_0.jpg \n", encoding="utf-8")
    assert [tuple(r) for r in files.read_asset_pool(spark, str(tmp_path / "pool.txt")).collect()] == [("X1", "https://a/x1_0.jpg")]
    (tmp_path / "k.json").write_text('{"_t": {"notes": "n"}, "a": {"notes": "m"}}', encoding="utf-8")
    assert [tuple(r) for r in files.read_keyed_json(spark, str(tmp_path / "k.json"), "struct<notes:string>").select("key", "value.notes").collect()] == [("a", "m")]
    rows = spark.createDataFrame([("n", ['a"b', "c"])], "name string, hints array<string>")
    files.write_review_csv(rows, str(tmp_path / "csv"), ("name", "hints"))
    assert '"n","a""b | c"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).split("\n")
    snap = spark.createDataFrame([("a", "i"), ("b", "")], "name string, image string")
    assert tuple(files.publish_snapshot(snap, str(tmp_path / "s"), "1").first()) == (2, 1, 1)
    with pytest.raises(Exception):  # noqa: B017
        files.publish_snapshot(snap, str(tmp_path / "s"), "1")
    kv = spark.createDataFrame([(1, "p:a", "1"), (1, "q:b", "2"), (2, "p:a", "3")], "user_id long, key string, value string")
    stores = files.export_state(kv, "p:")
    assert sorted(r["json"] for r in stores.collect()) == ['{"p:a":"1"}', '{"p:a":"3"}']  # a row a user
    assert sorted(tuple(r) for r in files.import_state(stores, "p:").collect()) == [(1, "p:a", "1"), (2, "p:a", "3")]
    assert files.import_state(spark.createDataFrame([('{"p:a": 1, "p:b": "x"}',)], "json string"), "p:").count() == 1


def test_variant_match_outcomes(spark):
    rows = spark.createDataFrame([("渡邊一", ""), ("髙橋二", ""), ("安倍", ""), ("既", "own")], "name string, image string")
    pairs = spark.createDataFrame([("渡辺一", "u1", "i1", 0), ("高橋二", "u2", "i2", 1), ("髙橋二", "u3", "i3", 2), ("渡辺一", "u1", "i1", 3)], "name string, url string, image string, ord long")
    got = {r["name"]: (r["outcome"], r["image"], r["image_candidates"]) for r in linking.match_variants(rows, pairs).collect()}
    assert got == {"渡邊一": ("matched", "i1", []), "髙橋二": ("ambiguous", "", ["i2", "i3"]), "安倍": ("none", "", []), "既": ("already", "own", [])}


def test_containment_both_ways_agree_and_reject_two_names(spark):
    texts = spark.createDataFrame([(1, "xx安倍晋三yy"), (2, "安倍晋三と麻生太郎"), (3, "")], "text_id long, text string")
    names = spark.createDataFrame([(10, "安倍晋三"), (11, "麻生太郎"), (12, "")], "entity_id long, key string")
    assert [tuple(r) for r in linking.link_contained(texts, names).collect()] == [(1, 10)]
    assert sorted(tuple(r) for r in linking.link_contained(texts, names, unique=False).collect()) == [(1, 10), (2, 10), (2, 11)]
    assert linking.link_contained(texts, names.limit(0)).count() == 0


def test_contained_names_equal_brute_force(spark, monkeypatch):
    from kairan.operators import containing

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé日") for _ in range(n))
    texts = [(i, rng.choice([None, "", word(rng.randint(1, 90))])) for i in range(200)] + [(900, word(3000))]
    cut = lambda t, n: t[(at := rng.randrange(max(1, len(t) - n))) : at + n]
    names = [(i, word(rng.randint(1, 40))) for i in range(150)] + [(500 + i, cut(t, rng.randint(3, 70))) for i, t in texts if t] + [(800, None), (801, "")]
    want = {(i, e) for i, t in texts for e, k in names if t and k and k in t}
    got = linking.link_contained(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "entity_id long, key string"), unique=False)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 300
    monkeypatch.setattr(containing, "STRETCH", 7)
    found = containing.finder(spark.createDataFrame(names, "entity_id long, key string"))
    for _, t in texts:
        assert {k for _, k in names if t and k and k in t} <= found.candidates(t or "")
    monkeypatch.setattr(containing, "MOST_BITS", 32768)  # filters that pass nearly all lose nothing
    many = spark.range(30_000).select(F.col("id").alias("entity_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("key"))
    rows = linking.link_contained(spark.createDataFrame([(1, "xn17y"), (2, "n31000")], "text_id long, text string"), many, unique=False).collect()
    assert {tuple(r) for r in rows} == {(1, 1), (1, 17), (2, 3), (2, 31), (2, 310), (2, 3100)}


def test_plain_text_equals_columns(spark):
    from kairan.functions import text

    rng = random.Random(10)
    signs = ["a", "b ", "<b>", "</i>", "<", ">", "&amp;", "&lt;", "&gt;", "&nbsp;", "&quot;", "<![CDATA[", "]]>", "\u3000", "\ufeff", "\n", "\x1c", "x"]
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select("x", text.html_text(F.col("x")).alias("y"))
    assert all(text.plain_text(r["x"]) == r["y"] for r in df.collect())


def test_a_page_of_many_hits(spark):
    import time

    html = "".join(f"<a href='{i}'>URL name{i}</a>" for i in range(20_000))
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    names = spark.range(0, 20_000, 4).select(F.col("id").alias("entity_id"), F.concat(F.lit("name"), F.col("id").cast("string"), F.lit(" ")).alias("key"))
    began = time.time()
    assert linking.link_near(pages, names, "URL", 60).count() > 10_000 and time.time() - began < 30


def test_links_nearby_equal_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    names = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(2, 4)))) for i in range(12)]
    pages = [(i, "".join(rng.choice(["URL", "ab", "cd", "da", "<b>", "x", " ", "&amp;"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    want = set()
    for page_id, html in pages:
        for pos, m in enumerate(re.finditer("URL", html)):
            around = html[max(0, m.start() - 9) : m.end() + 9]
            plain = " ".join(re.sub("<[^>]+>", " ", around.replace("&amp;", "&")).split())
            hits = {i for i, key in names if key in plain}
            want |= {(page_id, pos, "URL", *hits)} if len(hits) == 1 else set()
    got = linking.link_near(spark.createDataFrame(pages, "page_id long, html string"), spark.createDataFrame(names, "entity_id long, key string"), "URL", 9).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_aliases_of_exactly_one_entity(spark):
    mentions = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", "b"]), (4, ["c"]), (5, []), (6, ["a", "d"])], "mention_id long, x array<string>")
    entities = spark.createDataFrame([(10, ["a", "a", "d"]), (11, ["b"]), (12, ["c"]), (13, ["c"])], "entity_id long, x array<string>")
    got = linking.match_aliases(mentions, entities, F.col("x"), F.col("x"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10), (3, 11), (6, 10)]
    assert linking.match_aliases(mentions, entities, F.col("x"), F.col("x"), many=True).count() == 7


def test_windows_of_text(spark):
    pages = spark.createDataFrame([(1, "aaa URL bbb <i>c</i> URL d")], "page_id long, html string")
    got = [tuple(r) for r in linking.windows_of_text(pages, "URL", 4).orderBy("pos").select("pos", "text").collect()]
    assert got == [(0, "aaa URL bbb"), (1, "/i> URL d")]


def test_zip_by_position_fails_when_short(spark):
    a, b = spark.range(3).withColumnRenamed("id", "ord"), spark.range(2).select(F.col("id").alias("ord"), F.lit(1).alias("x"))
    with pytest.raises(Exception, match="shorter"):
        linking.zip_by_position(a, b).collect()


def test_ranked_spreads_one_key(spark):
    got = [r["n"] for r in ranking.ranked(spark.range(1000).withColumn("k", F.lit(1)), ["k"], [F.col("id").desc()], "n").orderBy(F.desc("id")).collect()]
    assert got == list(range(1, 1001))


def test_choices_of_a_small_pool(spark):
    rows = spark.range(3)
    assert all(sorted(r["choices"]) == [0, 1, 2] for r in ranking.make_choices(rows, rows, "s").collect())
    rows = spark.range(50)
    for r in ranking.make_choices(rows, rows, "s").collect():
        assert r["id"] in r["choices"] and len(set(r["choices"])) == 4


def test_table_json_lines_and_charsets(spark):
    head = ["氏名", "ふりがな"]
    html = "<table><tr><th>氏名</th><th>ふりがな</th></tr><tr><td>山田<table><tr><td>x</td></tr></table></td><td>やまだ</td></tr><tr><td>one</td></tr></table>"
    assert [tuple(r) for r in markup.extract_table(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"), head).select("cells").collect()] == [(["山田", "やまだ"],)]
    docs = spark.createDataFrame([(1, '{"a": [{"b": {"t": "x", "u": "https://h/i.png", "width": 5}}]}'), (2, "{"), (3, None)], "doc_id long, json string")
    assert [tuple(r) for r in markup.walk_json(docs).collect()] == [(1, 0, "x https://h/i.png", "https://h/i.png", 5, None)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["大臣", "・担当", "山田（やまだ）", "参議院", "noise", "長官", "佐藤（さとう）", "END", "後（あと）"])], "page_id long, pos int, line string")
    got = markup.group_lines(lines, F.col("line").contains("（"), F.col("line").isin("参議院", "衆議院"), F.col("line") == "noise", F.col("line") == "END").orderBy("record").collect()
    assert [(r["name"], r["roles"], r["suffix"]) for r in got] == [("山田（やまだ）", ["大臣", "担当"], "参議院"), ("佐藤（さとう）", ["長官"], None)]
    raw = spark.createDataFrame([("a", bytearray("議員".encode("shift_jis")))], "path string, content binary")
    assert markup.decode_best(raw, ["議員"]).first()["charset"] == "shift_jis"


def test_images_and_links(spark):
    pages = spark.createDataFrame([(1, "https://s.jp/d/", '<a href="/x?1">T &amp; U</a><img class="i" src="a.jpg" alt="n">')], "page_id long, url string, html string")
    assert [tuple(r) for r in markup.extract_links(pages).select("href", "text", "absolute").collect()] == [("/x?1", "T & U", "https://s.jp/x")]
    assert [tuple(r) for r in markup.extract_images(pages).select("src", "alt").collect()] == [("a.jpg", "n")]
    images = spark.createDataFrame([(1, "https://s.jp/yamada.jpg", ""), (1, "https://s.jp/noimage.jpg", "")], "page_id long, url string, alt string")
    names = spark.createDataFrame([(1, "yamada")], "page_id long, name string")
    assert [tuple(r) for r in assets.page_candidates(images, names).select("url", "score").collect()] == [("https://s.jp/yamada.jpg", 9)]


def test_gate(spark):
    kind = "name string, sub_role string, chamber string"
    good, bad = spark.createDataFrame([("a", "r", "c"), ("b", "r", "c")], kind), spark.createDataFrame([("a", "", "c")], kind)
    assert quality.gated_publish(good, bad, 1).count() == 2 and quality.gated_publish(bad, good, 1).count() == 2
    assert quality.validate_set(good.limit(0), 1).first()["reason"] == "empty"


def test_merge_is_idempotent_and_keeps_old_rows(spark):
    kind = "name string, party string, ord long"
    new, old = spark.createDataFrame([("a", "", 0)], kind), spark.createDataFrame([("a", "P", 0), ("b", "Q", 1)], kind)
    got = {r["name"]: (r["party"], r["source_mode"]) for r in roster.merge_keep(new, old, ["name"]).collect()}
    assert got == {"a": ("P", "live"), "b": ("Q", "seed")}


def test_leech_and_wrong_set(spark):
    kind = "user_id long, mode string, target string, id long, at long, seq long, grade string"
    grades = ["again", "again", "again", "good", "good", "strong"]
    graded = spark.createDataFrame([(1, "m", "t", 5, i, i, g) for i, g in enumerate(grades)], kind)
    steps = learning.trail(graded).orderBy("seq").collect()
    assert [r["after"]["interval_min"] for r in steps[:3]] == [10, 30, 240]
    assert steps[0]["before"] is None and all(a["after"] == b["before"] for a, b in zip(steps, steps[1:], strict=False))
    assert tuple(learning.lifetime_stats(graded).first()) == (1, 6, 3, 3, 0, 1)
    assert tuple(learning.mastered_wrong_sets(graded).select("in_mastered", "in_wrong").first()) == (False, False)


def test_an_item_of_a_million_answers(spark):
    """No row ever holds an item's history: a state goes from batch to batch."""
    from kairan.functions.memory import step

    n, grades = 1_000_000, ("good", "again", "hard", "strong", "good", "good", "good")
    events = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.lit("m").alias("mode"), F.lit("t").alias("target"), F.lit(5).cast("long").alias("id"), (F.col("id") * 3_600_000).alias("at"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, grades)), (F.col("id") % 7 + 1).cast("int")).alias("grade"))
    state, again = None, 0
    for i in range(n):
        state = step(state, grades[i % 7], i * 3_600_000)
        again += grades[i % 7] == "again"
    got = learning.replay(events.repartition(8)).collect()
    assert len(got) == 1 and got[0]["state"].asDict() == state
    assert learning.lifetime_stats(events).first()["wrong"] == again


def test_replay_and_trail_go_on_from_stored_states(spark):
    kind = "user_id long, mode string, target string, id long, at long, seq long, grade string"
    rng = random.Random(2)
    rows = [(u, "m", "t", i, rng.randint(0, 10**9), s, rng.choice(["good", "again", "hard", "strong"])) for s, (u, i) in enumerate((rng.randint(1, 3), rng.randint(1, 4)) for _ in range(300))]
    every = spark.createDataFrame(rows, kind)
    early, late = every.filter("at < 500000000"), every.filter("at >= 500000000 and id <> 4")
    begun = learning.replay(early)
    key = lambda r: (r["user_id"], r["id"])
    whole = {key(r): r["state"] for r in learning.replay(every.filter("at < 500000000 or id <> 4")).collect()}
    assert {key(r): r["state"] for r in learning.replay(late, start=begun).collect()} == whole
    steps = {r["seq"]: (r["before"], r["after"]) for r in learning.trail(every.filter("at < 500000000 or id <> 4")).collect()}
    assert {r["seq"]: (r["before"], r["after"]) for r in learning.trail(late, start=begun).collect()} == {r[5]: steps[r[5]] for r in rows if r[4] >= 500000000 and r[3] != 4}
    assert learning.replay(every.limit(0)).collect() == [] == learning.trail(every.limit(0)).collect()
    assert len(learning.replay(every.limit(0), start=begun).collect()) == begun.count()


def test_batches_run_again_count_once(spark, tmp_path):
    from kairan.streaming import review

    kind = "user_id long, id long, at long, seq long, grade string"
    one, two = (spark.createDataFrame(rows, kind) for rows in ([(1, 5, 100, 1, "good"), (2, 5, 100, 2, "again")], [(1, 6, 300, 3, "hard")]))
    write = review.counters_sink(str(tmp_path / "c"))
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 0)):
        write(batch, number)
    assert sorted(map(tuple, review.read_counters(spark, str(tmp_path / "c")).collect())) == [(1, 2, 2, 0, 1, 300), (2, 1, 0, 1, 1, 100)]


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    from kairan.streaming.review import set_changes, stream_state, use_state_store

    use_state_store(spark)
    kind = "user_id long, mode string, target string, id long, at long, seq long, grade string"
    one = lambda rows, n: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    for n, rows in enumerate([[(1, "m", "t", 5, 100, 1, "good")], [(1, "m", "t", 5, 50, 0, "again"), (1, "m", "t", 5, 200, 2, "good")]]):
        one(rows, n)
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = stream_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, e: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert (out[-1]["dropped"], out[-1]["reps"], out[-1]["lapses"]) == (1, 2, 0)
    one([(1, "m", "t", 5, 300 + i, 3 + i, g) for i, g in enumerate(["again", "good", "good", "again"])], 2)
    stream = stream_state(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), idle_ms=3_600_000)
    told = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, e: told.extend(set_changes(df).collect())).option("checkpointLocation", str(tmp_path / "d")).start()
    for _ in range(60):  # a stream with times to live goes on by itself
        q.awaitTermination(1)
        if told:
            break
    q.stop()
    assert [(r["seq"], r["set"], r["change"]) for r in told][-3:] == [(3, "wrong", "added"), (5, "wrong", "removed"), (6, "wrong", "added")]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(ValueError, match="use_state_store"):
        stream_state(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))


def test_next_items_equal_brute_force(spark):
    """Every learner's next item, by a plain search of learners x people."""
    import hashlib
    import math
    import random

    from kairan.functions.memory import DAY, STATE

    rng, now = random.Random(5), 400 * DAY
    people = [("t", i) for i in range(25)] + [("u", i) for i in range(100, 104)]
    recent, states = {2, 3, 4, 7, 101}, []
    for user in range(60):
        seen = rng.sample(range(25), rng.choice([1, 3, 12, 20, 24, 25]))
        for i in seen:
            status, due = rng.choice(["learning", "review", "mastered", "leech"]), now + rng.randint(-9, 30) * DAY
            states.append((user, "m", "t", i, dict(reps=1, interval_min=1, due=due, last_grade="good", updated_at=0, stability=float(rng.randint(1, 90)), difficulty=5.0, lapses=rng.randint(0, 4), consecutive=1, status=status, last_seen_at=now - rng.randint(0, 60) * DAY)))
    states.append((60, "m", "u", 100, states[0][4]))
    states.append((61, "m", "t", 999, states[0][4]))  # seen, no longer in the roster
    asked = [(u, rng.randrange(25)) for u in range(60) for _ in range(rng.choice([0, 2, 7, 11, 23]))]
    kind = "user_id long, mode string, target string, id long, state " + STATE
    s_df, a_df = spark.createDataFrame([(*r[:4], tuple(r[4].values())) for r in states], kind), spark.createDataFrame(asked, "user_id long, id long")
    p_df, r_df = spark.createDataFrame(people, "target string, id long"), spark.createDataFrame([(i,) for i in recent], "id long")
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    users = sorted({(r[0], r[2]) for r in states})
    starts = {(r[0], r[1]): r[2] for r in spark.createDataFrame(users, "u long, t string").select("u", "t", F.xxhash64(F.lit("0"), "u", "t")).collect()}
    lucky = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u, _ in users], "u long").select("u", F.pmod(F.crc32(F.concat_ws(":", F.lit("0"), F.col("u").cast("string"))), F.lit(20)) == 0).collect()}
    for mode in ("normal", "review"):
        want = {}
        for user, target in users:
            own = {r[3]: r[4] for r in states if r[0] == user}
            out = {i for u, i in asked if u == user}
            roster_ids = [i for t, i in people if t == target]
            rows = []
            for i in (i for i in roster_ids if i in own and i not in out):
                s = own[i]
                recall = math.exp(-max(now - s["last_seen_at"], 0) / DAY / max(s["stability"], 0.15))
                risk = round(1 - recall + (0.5 + min((now - s["due"]) / DAY, 6) * 0.18 if s["due"] <= now else 0) + 0.45 * (s["status"] == "leech") + min(s["lapses"] * 0.08, 0.4), 9)
                soon = s["due"] - now <= DAY * min(max(s["stability"], 1), 7) or risk >= 0.55
                bucket = "mastered" if s["status"] == "mastered" and s["due"] > now else "leech" if s["status"] == "leech" else "due" if s["due"] <= now else "upcoming" if soon else None
                rows += [(bucket, -risk, md5("0", user, i) if bucket == "mastered" else "", i)] if bucket else []
                rows += [("recent", -risk, "", i)] if i in recent and bucket != "mastered" else []
            rows += [("recent", 0.0, "", i) for i in roster_ids if i in recent and i not in own and i not in out]
            ring = sorted((i for i in roster_ids if i not in recent), key=lambda i: (md5("0", i), i))
            turned = [ring[(starts[user, target] + k) % len(ring)] for k in range(len(ring))]
            rows += [("fresh", 0.0, "", i) for i in turned if i not in own and i not in out][:1]
            best = {}
            for b, most in (("recent", 2), ("leech", 2), ("due", 3), ("upcoming", 3), ("fresh", 1), ("mastered", 1)):
                top = [r[3] for r in sorted(r for r in rows if r[0] == b)][:most]
                if top:
                    best[b] = min(top, key=lambda i: md5("0", user, b, i))
            n = len(out)
            c = n % 20
            rules_ = [("recent", n < 6 or c in (0, 7, 14)), ("leech", c in (2, 9, 15)), ("due", c < 11), ("upcoming", c < 16), ("recent", True), ("fresh", True), ("mastered", lucky[user])] if mode == "normal" else []
            pick = next((b for b, on in [*rules_, ("leech", True), ("due", True), ("upcoming", True)] if on and b in best), None)
            if pick:
                want[user] = (best[pick], pick)
        got = {r["user_id"]: (r["id"], r["bucket"]) for r in learning.next_items(p_df, s_df, a_df, r_df, F.lit(now), mode).collect()}
        assert got == want and len({b for _, b in got.values()}) >= (4 if mode == "normal" else 3)


def test_stored_tables_go(spark, tmp_path, monkeypatch):
    from kairan.sources import store

    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    names = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "kairan").glob("*"))
    a = store.stored(spark.range(5), "a")
    out = store.settled(lambda: store.stored(a.filter("id > 1"), "b").withColumn("x", F.lit(1)), "c")
    assert names() == ["a", "c"] and sorted(r["id"] for r in out.collect()) == [2, 3, 4]
    store.release(a, None, spark.range(1))
    assert names() == ["c"]
    store.clear(spark)
    assert names() == []


def test_feed_history_keeps_the_newest_feeds(spark):
    rows = spark.createDataFrame([(1, g, v) for g, v in (("a", 1), ("b", 2), ("a", 3), ("c", 0))] + [(2, "a", 9)], "user_id long, generated_at string, viewed_at long")
    got = sorted(tuple(r) for r in ranking.feed_history(rows, 2).select("user_id", "generated_at", "viewed_at").collect())
    assert got == [(1, "a", 3), (1, "b", 2), (2, "a", 9)]


def test_attributes_of_any_kind(spark):
    tags = ["<img alt=\"Jean d'Arc\" src=b.jpg>", "<img alt='x src=\"no\"' SRC='a>b.png'/>", "<img data-src=x.jpg class=c>", "<img src=\"\" alt=a>", "<img src>", "<img  src = 'sp ace' src=two>"]
    pages = spark.createDataFrame([(1, "u", "<!-- <img src=no> -->" + "".join(tags) + "<a  class='x' href=rel/p>T <b>b</b></a><a title='>' HREF=\"q\">Q</a>")], "page_id long, url string, html string")
    got = [(r["src"], r["data_src"], r["alt"]) for r in markup.extract_images(pages).orderBy("ord").collect()]
    assert got == [("b.jpg", "", "Jean d'Arc"), ("a>b.png", "", 'x src="no"'), ("", "x.jpg", ""), ("", "", "a"), ("", "", ""), ("sp ace", "", "")]
    assert [(r["href"], r["text"]) for r in markup.extract_links(pages).orderBy("ord").collect()] == [("rel/p", "T b"), ("q", "Q")]


def test_page_records_equal_grouped_lines(spark):
    rng = random.Random(11)
    texts = [(i, "\n".join(rng.choice(["N one", "N two", "・ role a", "role b", "(s)", "junk", "END", "", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(500, None)]
    pages = spark.createDataFrame(texts, "page_id long, text string")
    tests = [lambda x: x.startswith("N"), lambda x: x == "(s)", lambda x: x == "junk", lambda x: x == "END"]
    for k in range(1, 5):
        ours = markup.page_records(pages, *tests[:k])
        theirs = markup.group_lines(markup.text_lines(pages), *(t(F.col("line")) for t in tests[:k]))
        key = lambda r: (r["page_id"], r["record"], r["name"], tuple(r["roles"]), r["suffix"])
        assert sorted(map(str, map(key, ours.collect()))) == sorted(map(str, map(key, theirs.collect())))


def test_snapshots_in_buckets_meet_without_a_shuffle(spark, tmp_path):
    rows = [spark.createDataFrame([person(i, f"n{i % k}") for i in range(40)], PERSON) for k in (40, 39)]
    sides = [files.bucketed_snapshot(df, f"side{i}", str(tmp_path / f"b{i}"), buckets=4) for i, df in enumerate(rows)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compared = diff.diff_snapshots(*sides)
        assert "Exchange" not in compared._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, compared.collect())) == sorted(map(str, diff.diff_snapshots(*rows).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cycles_are_clamped(spark):
    cycles = spark.createDataFrame([(1, -3, [5, 6, 7]), (2, 9, [5, 6]), (3, 1, [8]), (4, 1, [9, 5, 6, 7])], "user_id long, cursor int, order array<long>")
    people, asked = spark.createDataFrame([(5,), (6,), (7,)], "id long"), spark.createDataFrame([(1, 5), (4, 6)], "user_id long, id long")
    assert sorted(map(tuple, learning.next_in_cycle(cycles, asked, people).collect())) == [(1, 6, 0, 1), (2, None, 2, 2), (4, 7, 1, 2)]


def test_no_snapshot_is_no_rows(spark, tmp_path):
    assert files.read_snapshot(spark, str(tmp_path), PERSON).count() == 0


def test_json_by_ranges_equals_whole_files(spark, tmp_path):
    from kairan.sources.ranges import read_elements

    rng = random.Random(12)
    signs = ["a", "\\", '"', "[", "]", "{", "}", ",", "é", "日", " ", "\n"]
    word = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))
    deep = lambda n: rng.choice([word(), rng.randint(-9, 9), None, True, [], {}, word()]) if n == 0 else rng.choice([[deep(n - 1) for _ in range(rng.randint(0, 3))], {word(): deep(n - 1) for _ in range(rng.randint(0, 3))}])
    arrays = [[deep(rng.randint(0, 3)) for _ in range(rng.randint(0, 12))] for _ in range(12)] + [[], [1]]
    for i, a in enumerate(arrays):
        (tmp_path / f"a{i}.json").write_text(json.dumps(a, ensure_ascii=i % 2 == 0, indent=rng.choice([None, 1])) + rng.choice(["", "\n "]), encoding="utf-8")
    for i, broken in enumerate(["[1, 2", "1, 2]", "[1,]", "[,1]", "[1] 2", "[1] [2]", "[1, x]", "", " ", '{"a": 1}', '["a]', "[1}]"]):
        (tmp_path / f"b{i}.json").write_text(broken)
    for size in (7, 1 << 20):
        got = {}
        for r in read_elements(spark, str(tmp_path), "[", size).select("path", "ord", F.to_json("v").alias("j")).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["ord"]] = json.loads(r["j"])
        assert got == {f"a{i}.json": dict(enumerate(a)) for i, a in enumerate(arrays) if a}
    objects = {word() + str(i): deep(2) for i in range(20)}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "o.json").write_text(json.dumps(objects))
    merged = {}
    for r in read_elements(spark, str(tmp_path / "o"), "{", 11).select(F.to_json("v").alias("j")).collect():
        merged |= json.loads(r["j"])
    assert merged == objects
