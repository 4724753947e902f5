"""Study logs: replay into memory state, counters, summaries, sets, queues of next items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.functions.memory import DAY, STATE, forgetting_score, is_mastered, recall, step
from kairan.operators import folding
from kairan.operators.ranking import ranked, seeded
from kairan.sources.store import stored

#: Recent ids that are broadcast, at most (counted first).
BROADCAST_IDS = 100_000
KEYS = ("user_id", "mode", "target", "id")


#: What orders an item's answers: time, then number, then grade.
ORDER = ("at", "seq", "grade")


def _answers(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return events.select(*keys, F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), "grade")


def replay(events: DataFrame, keys: tuple[str, ...] = KEYS, start: DataFrame | None = None) -> DataFrame:
    """``keys`` and the memory ``state`` after all grades of each item.

    With ``start`` (keys and ``state``, as an earlier replay gave it) only ``events`` that came since are folded; items
    without any keep their state.
    """
    return folding.fold(_answers(events, keys), keys, ORDER, lambda s: s, lambda s, at, seq, grade: step(s, grade, at), lambda s: (s,), f"state {STATE}", start)


def trail(events: DataFrame, keys: tuple[str, ...] = KEYS, start: DataFrame | None = None) -> DataFrame:
    """One row an event: ``keys``, ``at``, ``seq``, ``grade``, ``before`` and ``after`` states; see ``replay``."""
    change = lambda s, at, seq, grade: (s[1], step(s[1], grade, at))
    return folding.trace(_answers(events, keys), keys, ORDER, lambda s: (None, s), change, lambda s: s, f"before {STATE}, after {STATE}", start)


def lifetime_stats(events: DataFrame, keys: tuple[str, ...] = ("user_id",), item: tuple[str, ...] = KEYS) -> DataFrame:
    """Played, correct, wrong, and steps into mastered and into leech: folded to counters an item, then added up."""
    names = ("played", "correct", "wrong", "mastered", "leech")

    def change(told, at, seq, grade):
        before, counts = told
        after = step(before, grade, at)
        into = lambda status: after["status"] == status and (before is None or before["status"] != status)
        hits = (True, grade != "again", grade == "again", into("mastered"), into("leech"))
        return after, tuple(n + hit for n, hit in zip(counts, hits, strict=True))

    counted = folding.fold(_answers(events, item), item, ORDER, lambda s: (s, (0,) * 5), change, lambda s: s[1], ", ".join(f"{n} long" for n in names))
    return counted.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in names))


def progress_summary(people: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Per (user, mode, target): total, remembered, hazy, not_remembered, not_checked, due_soon, leech.

    Only seen items are joined; the total comes from the roster's size, so people x learners is never built.
    """
    s = F.col("state")
    seen = states.join(people.select("target", "id").distinct(), ["target", "id"], "left_semi")
    r = recall(s, now)
    kind = F.when(is_mastered(s, now), "remembered").when(s["status"] == "leech", "leech").when((s["last_grade"] == "again") | (r < 0.35) | (s["lapses"] >= 2), "not").otherwise("hazy")
    soon = ~kind.isin("remembered", "leech") & ((s["due"] - now <= 7 * DAY) | (r <= 0.55))
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    sums = seen.withColumns({"kind": kind, "soon": soon}).groupBy("user_id", "mode", "target").agg(n("remembered").alias("remembered"), n("hazy").alias("hazy"), n("not", "leech").alias("not_remembered"), F.count_if("soon").alias("due_soon"), n("leech").alias("leech"))
    totals = people.groupBy("target").agg(F.countDistinct("id").alias("total"))
    left = F.greatest(F.col("total") - F.col("remembered") - F.col("hazy") - F.col("not_remembered"), F.lit(0))
    return sums.join(totals, "target").select("user_id", "mode", "target", "total", "remembered", "hazy", "not_remembered", left.cast("long").alias("not_checked"), "due_soon", "leech")


def focus_summary(people: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Per (user, mode, target): due, leech, mastered items of the roster."""
    s = F.col("state")
    seen = states.join(people.select("target", "id").distinct(), ["target", "id"], "left_semi")
    done = is_mastered(s, now)
    return seen.groupBy("user_id", "mode", "target").agg(F.count_if(~done & ((s["due"] <= now) | (forgetting_score(s, now) >= 0.55))).alias("due"), F.count_if(~done & (s["status"] == "leech")).alias("leech"), F.count_if(done).alias("mastered"))


def session_result(events: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Total, good, hard, again (strong counts in total only) and the distinct wrong ids in order."""
    n = lambda g: F.count_if(F.col("grade") == g)
    wrong = F.sort_array(F.collect_set(F.when(F.col("grade").isin("hard", "again"), F.col("id"))))
    return events.groupBy(*keys).agg(F.count("*").alias("total"), n("good").alias("remembered"), n("hard").alias("hazy"), n("again").alias("not_remembered"), wrong.alias("wrong_ids"))


def miss_memory(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``miss_count``, ``last_miss_at`` over hard and again."""
    return events.filter(F.col("grade").isin("hard", "again")).groupBy(*keys).agg(F.count("*").alias("miss_count"), F.max("at").alias("last_miss_at"))


def mastered_wrong_sets(events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``in_mastered`` and ``in_wrong`` after all grades of each item.

    Mastered follows the last status; wrong is set by again or a leech, cleared by good from two in a row on; other
    grades (strong too) leave it.
    """

    def change(told, at, seq, grade):
        after = step(told[0], grade, at)
        return after, wrong_after(told[1], grade, after)

    return folding.fold(_answers(events, keys), keys, ORDER, lambda s: (s, False), change, lambda s: (s[0]["status"] == "mastered", s[1]), "in_mastered boolean, in_wrong boolean")


def wrong_after(wrong: bool, grade: str, after: dict) -> bool:
    """Whether an item is in the wrong set after a grade that has led to the state ``after``."""
    if grade == "again" or after["status"] == "leech":
        return True
    return wrong and not (grade == "good" and after["consecutive"] >= 2)


def order_by_risk(states: DataFrame, now: Column, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """``risk`` and ``risk_rank`` in each learner's items: highest forgetting score first, then id."""
    scored = states.withColumn("risk", F.round(forgetting_score(F.col("state"), now), 9))
    return scored.withColumn("risk_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("risk"), "id")))


def restrict(rows: DataFrame, ids: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return rows.join(ids.select(*cols).distinct(), cols, "left_semi")


def _unseen(learners: DataFrame, roster: DataFrame, taken: DataFrame, start: Column, most: int) -> DataFrame:
    """``user_id``, ``target``, ``id``: for each learner the first ``most`` people of a numbered roster not ``taken``.

    ``roster`` has target, id and ``_pos`` (from 0) of ``_n`` people of the target; a learner reads it as a ring from
    ``start``. Only the learner's own taken people are counted, in the ring's order: the k-th of them stands at k or
    beyond, and where it first stands beyond is a free place. No learner meets the whole roster.
    """
    sizes = roster.groupBy("target").agg(F.first("_n").alias("_n"))
    ring = learners.join(F.broadcast(sizes), "target").withColumn("_start", F.pmod(start, F.col("_n")))
    own = taken.select("user_id", "target", "id").distinct().join(roster.select("target", "id", "_pos"), ["target", "id"]).join(ring.drop("_n"), ["user_id", "target"]).join(F.broadcast(sizes), "target")
    placed = own.withColumn("_at", F.pmod(F.col("_pos") - F.col("_start"), F.col("_n")))
    ahead = placed.withColumn("_ahead", F.col("_at") - F.row_number().over(Window.partitionBy("user_id", "target").orderBy("_at")) + 1)
    free = ahead.groupBy("user_id", "target").agg(*(F.count_if(F.col("_ahead") <= k).alias(f"_free{k}") for k in range(most)))
    wanted = ring.join(free, ["user_id", "target"], "left").withColumn("_at", F.explode(F.array(*(F.coalesce(f"_free{k}", F.lit(0)) + k for k in range(most)))))
    wanted = wanted.filter(F.col("_at") < F.col("_n")).select("user_id", "target", F.pmod(F.col("_at") + F.col("_start"), F.col("_n")).alias("_pos"))
    return wanted.join(roster.select("target", "id", "_pos"), ["target", "_pos"]).select("user_id", "target", "id")


def next_items(people: DataFrame, states: DataFrame, asked: DataFrame, recent: DataFrame, now: Column, mode: str = "normal", seed: str = "0") -> DataFrame:
    """``user_id``, ``id``, ``bucket``: each learner's next item.

    Items the learner was asked are out. Buckets are recent, leech, due, upcoming, fresh and mastered; which is asked
    follows the count of asked items mod 20, in review leech, due, upcoming; one of a bucket's two or three riskiest
    is picked by seed. Learners are those with a state; they join only people they have seen. A fresh person is the
    first unseen one from a seeded place of the target's seeded order, an unseen recent one the first by id: both are
    found from the learner's own history, so that learners x people is never built.
    """
    s = F.col("state")
    states = stored(states.select("user_id", "target", "id", "state"), "states")  # read four times below
    roster = people.select("target", "id").distinct()
    news = recent.select("id").distinct()
    learners = states.select("user_id", "target").distinct()
    asked_ = asked.select("user_id", "id").distinct()
    seen = states.select("user_id", "target", "id", "state").join(roster, ["target", "id"], "left_semi")
    seen = seen.join(asked_, ["user_id", "id"], "left_anti").join(F.broadcast(news.withColumn("_recent", F.lit(True))) if news.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else news.withColumn("_recent", F.lit(True)), "id", "left").withColumn("_recent", F.coalesce("_recent", F.lit(False)))
    risk = F.round(forgetting_score(s, now), 9)
    soon = (s["due"] - now <= F.lit(float(DAY)) * F.least(F.greatest(s["stability"], F.lit(1.0)), F.lit(7.0))) | (risk >= 0.55)
    kind = F.when(is_mastered(s, now), "mastered").when(s["status"] == "leech", "leech").when(s["due"] <= now, "due").when(soon, "upcoming").otherwise("none")
    placed = seen.withColumns({"risk": risk, "kind": kind})
    known = placed.withColumn("bucket", F.explode(F.filter(F.array(F.col("kind"), F.when(F.col("_recent") & (F.col("kind") != "mastered"), F.lit("recent"))), lambda b: b.isNotNull() & (b != "none")))).select("user_id", "id", "risk", "bucket")
    taken = states.select("user_id", "target", "id").unionByName(learners.join(asked_, "user_id"))
    numbered = lambda df, order: ranked(df, ["target"], [*order, F.col("id").asc()], "_pos").withColumn("_pos", F.col("_pos") - 1).join(F.broadcast(df.groupBy("target").agg(F.count("*").alias("_n"))), "target")
    others = numbered(roster.join(news, "id", "left_anti").withColumn("_h", seeded(seed, "id")), [F.col("_h").asc()])
    fresh = _unseen(learners, others, taken, F.xxhash64(F.lit(seed), "user_id", "target"), 1)
    unseen = _unseen(learners, numbered(roster.join(news, "id", "left_semi"), []), taken, F.lit(0).cast("long"), 2)
    zero = F.lit(0.0).alias("risk")  # an unseen item's
    buckets = known.unionByName(fresh.select("user_id", "id", zero, F.lit("fresh").alias("bucket"))).unionByName(unseen.select("user_id", "id", zero, F.lit("recent").alias("bucket")))
    order = F.when(F.col("bucket").isin("fresh", "mastered"), seeded(seed, "user_id", "id"))
    w = Window.partitionBy("user_id", "bucket").orderBy(F.desc("risk"), order, "id")
    band = F.when(F.col("bucket").isin("recent", "leech"), 2).when(F.col("bucket").isin("fresh", "mastered"), 1).otherwise(3)
    top = buckets.withColumn("_n", F.row_number().over(w)).filter("_n <= 3").filter(F.col("_n") <= band)
    picked = top.groupBy("user_id", "bucket").agg(F.min_by("id", seeded(seed, "user_id", "bucket", "id")).alias("id"))
    counts = asked.groupBy("user_id").agg(F.countDistinct("id").alias("n"))
    table = picked.join(counts, "user_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cycle, b = F.col("n") % 20, F.col("bucket")
    lucky = F.pmod(F.crc32(F.concat_ws(":", F.lit(seed), F.col("user_id").cast("string"))), F.lit(20)) == 0
    fallback = F.when(b == "leech", 20).when(b == "due", 21).when(b == "upcoming", 22)
    if mode == "review":
        rank = fallback
    else:
        rank = (
            F.when((b == "recent") & ((F.col("n") < 6) | cycle.isin(0, 7, 14)), 1)
            .when((b == "leech") & cycle.isin(2, 9, 15), 2)
            .when((b == "due") & (cycle < 11), 3)
            .when((b == "upcoming") & (cycle < 16), 4)
            .when(b == "recent", 5)
            .when(b == "fresh", 6)
            .when((b == "mastered") & lucky, 7)
            .otherwise(fallback)
        )
    ranked_ = table.withColumn("_rank", rank).filter("_rank is not null")
    return ranked_.groupBy("user_id").agg(F.min_by(F.struct("id", "bucket"), "_rank").alias("p")).select("user_id", "p.id", "p.bucket")


def live_cycles(cycles: DataFrame, people: DataFrame) -> DataFrame:
    """``user_id``, ``order``, ``cursor`` of saved cycles: people who have left the roster go, the cursor lies within the rest.

    A cycle of which nobody is left goes.
    """
    spread = cycles.select("user_id", F.col("cursor").alias("_cursor"), F.posexplode("order").alias("_pos", "id")).join(people.select("id").distinct(), "id", "left_semi")
    kept = spread.groupBy("user_id", "_cursor").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "id"))), lambda x: x["id"]).alias("order"))
    return kept.select("user_id", "order", F.least(F.greatest(F.col("_cursor"), F.lit(0)), F.size("order")).cast("int").alias("cursor"))


def next_in_cycle(cycles: DataFrame, asked: DataFrame, people: DataFrame) -> DataFrame:
    """``user_id``, ``id``, ``cursor``, ``next_cursor``: each cycle's next item, and the cursor to save once it is graded.

    The item is the first from the cursor on that isn't asked, null if there is none; grading moves the cursor on by one,
    to the end at most. Cycles are those of ``live_cycles``.
    """
    live = live_cycles(cycles, people)
    ahead = live.select("user_id", "cursor", F.posexplode("order").alias("_pos", "id")).filter(F.col("_pos") >= F.col("cursor"))
    found = ahead.join(asked.select("user_id", "id").distinct(), ["user_id", "id"], "left_anti").groupBy("user_id").agg(F.min_by("id", "_pos").alias("id"))
    return live.join(found, "user_id", "left").select("user_id", "id", "cursor", F.when(F.col("id").isNotNull(), F.least(F.col("cursor") + 1, F.size("order"))).otherwise(F.col("cursor")).cast("int").alias("next_cursor"))
