"""Ordered dedup, best-per-key, balanced and seeded orders, samples and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.sources.store import stored


def dedup_keep(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row a key: the first (or last) by ``order``. Spark keeps one row a key in each task before the shuffle."""
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def best_per(df: DataFrame, keys: list[str], score: Column, order: list[str]) -> DataFrame:
    """The row of the highest score a key; the first by ``order`` wins ties."""
    by = [score.desc(), *(F.col(c).asc() for c in order)]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows a key by ``order``."""
    by = [F.col(c).desc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_n") <= n).drop("_n")


def seeded(seed: str, *cols: str) -> Column:
    """A reproducible random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in cols)))


def sample_n(df: DataFrame, n: int, seed: str, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """``n`` random rows (of each key): a seeded top-n, which never sorts the whole table in one task."""
    order = [seeded(seed, *(keys or []), id_col).asc(), F.col(id_col).asc()]
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers (from 1) within ``keys``, also where one key holds most rows.

    Rows are first dealt to ranges of the order; counts of the ranges before give each range its offset, so no task
    holds a whole key. ``order`` must be total within a key. The dealt rows are stored: range bounds are sampled, and a
    lost executor must not lead to other bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id())
    local = stored(dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))), "ranked")
    sizes = local.groupBy("_part", *keys).agg(F.count("*").alias("_size"))  # a row a range and key
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return local.join(offsets, ["_part", *keys]).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_part", "_rn", "_before")


def balanced_order(df: DataFrame, group: Column, seed: str, id_col: str) -> DataFrame:
    """``turn`` and ``group_rank``: round-robin order over groups, biggest group first, seeded order within a group.

    Ordering by (turn, group_rank) gives the cycle; both are columns, so that no global sort is forced.
    """
    labelled = df.withColumn("_group", group).withColumn("_key", seeded(seed, id_col))
    inside = ranked(labelled, ["_group"], [F.col("_key").asc(), F.col(id_col).asc()], "turn")
    sizes = labelled.groupBy("_group").agg(F.count("*").alias("_size"))
    order = ranked(sizes, [], [F.desc("_size"), F.col("_group").asc()], "group_rank").select("_group", F.col("group_rank").cast("int").alias("group_rank"))
    return inside.join(order, "_group").drop("_group", "_key")


def roster_order(key: str, placed: str | None = None) -> list[Column]:
    """Sort columns for ``name_asc``, ``name_desc``, ``district``, ``terms_asc/desc`` or ``year_asc/desc``.

    Names sort by reading, Japanese collation; missing numbers come last in both directions; ids break ties. ``placed``
    is a column of places in ``name_asc`` where these are known: other orders then compare numbers, not names.
    """
    from kairan.functions.text import clean_district, district_rank

    ja = lambda c: F.collate(c, "ja")
    reading = F.coalesce(F.nullif(F.trim("kana"), F.lit("")), F.col("name"))
    name = [ja(reading).asc(), ja(F.col("name")).asc(), F.col("id").asc()]
    name = [F.col(placed).asc()] if placed else name
    down = key.endswith("_desc")
    if key.startswith("name"):
        return [ja(reading).desc(), ja(F.col("name")).desc(), F.col("id").asc()] if down else name
    if key == "district":
        return [district_rank(F.col("district")).asc(), ja(clean_district(F.col("district"))).asc(), *name]
    number = F.col({"terms": "terms", "year": "next_election_year"}[key.split("_")[0]])
    return [number.isNull().asc(), number.desc() if down else number.asc(), *name]


def sort_roster(df: DataFrame, key: str) -> DataFrame:
    """Roster in the order of ``roster_order``."""
    return df.orderBy(*roster_order(key))


def review_order() -> list[Column]:
    return [F.desc("image_score"), F.collate(F.col("name"), "ja").asc(), F.col("name").asc()]


def sort_review(df: DataFrame) -> DataFrame:
    """Highest score first, then name."""
    return df.orderBy(*review_order())


def feed_history(feeds: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` feeds a viewer (``user_id``), one each ``generated_at``: of feeds seen again, the last view counts."""
    latest = dedup_keep(feeds, ["user_id", "generated_at"], ["viewed_at"], keep="last")
    return keep_last(latest, ["user_id"], ["viewed_at", "generated_at"], n)


def make_choices(questions: DataFrame, pool: DataFrame, seed: str, id_col: str = "id", others: int = 3) -> DataFrame:
    """``id`` (the answer) and ``choices``: itself and ``others`` other distinct ids, in a seeded order.

    Ids stand on a ring by hash; an answer takes its next neighbours, so each question costs a few equi-joined rows,
    never the whole pool. A pool of ``others`` + 1 ids or fewer gives all of them.
    """
    ring = ranked(pool.select(id_col).distinct().withColumn("_h", seeded(seed, id_col)), [], [F.col("_h").asc(), F.col(id_col).asc()], "at").select(F.col(id_col).alias("_id"), "at")
    size = F.broadcast(ring.agg(F.count("*").alias("n")))
    asked = questions.select(F.col(id_col).alias("id")).distinct().join(ring, F.col("id") == F.col("_id")).crossJoin(size)
    steps = asked.select("id", "n", "at", F.explode(F.sequence(F.lit(0), F.least(F.lit(others), F.col("n") - 1).cast("int"))).alias("step"))
    picked = steps.withColumn("want", (F.col("at") - 1 + F.col("step")) % F.col("n") + 1).join(ring.select(F.col("_id").alias("choice"), F.col("at").alias("want")), "want")
    shown = picked.withColumn("_h", seeded(seed, "id", "choice"))
    return shown.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", "choice"))), lambda x: x["choice"]).alias("choices"))
