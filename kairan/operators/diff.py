"""Change feed: snapshot diff, change sentences, counts, caps, reasons from news entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.functions import rules
from kairan.functions.text import html_text
from kairan.operators.ranking import dedup_keep

FIELDS = ("name", "kana", "role", "party", "district", "terms", "image")


def diff_snapshots(prev: DataFrame, curr: DataFrame, fields: tuple[str, ...] = FIELDS, keys: tuple[str, ...] = ("target", "key")) -> DataFrame:
    """One row a changed key: ``type`` (added, removed, changed), ``before`` and ``after`` structs, ``fields`` that differ.

    A repeated key has its last row's values at its first row's place. Both sides are dealt by all of ``keys`` (a
    roster kind alone has too few values), and dedup and join share that dealing.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        first = df.withColumn("_first", F.min("ord").over(w))
        last = dedup_keep(first, list(keys), ["ord"], keep="last")
        return last.select(*keys, F.col("_first").alias(f"{name}_ord"), F.struct(*fields).alias(name))

    both = side(prev, "before").join(side(curr, "after"), list(keys), "full_outer")
    differs = [F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]
    typed = both.select(*keys, F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("type"), "before", "after", F.coalesce("after_ord", "before_ord").alias("ord"), F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), F.filter(F.array(*differs), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("fields"))
    return typed.filter((F.col("type") != "changed") | (F.size("fields") > 0))


def change_summary(labels=rules.CHANGE_LABELS, asset: str = "image", asset_text: str = rules.ASSET_CHANGED, nothing: str = rules.NOTHING) -> Column:
    """Sentence of the changed fields for rows of ``diff_snapshots``; a changed asset adds only a fixed phrase."""
    def shown(side: str, field: str) -> Column:
        value = F.col(f"{side}.{field}").cast("string")
        unit = F.concat(value, F.lit("回")) if field == "terms" else value
        return F.coalesce(F.nullif(unit, F.lit("")), F.lit(nothing))

    parts = [F.when(F.array_contains("fields", f), F.concat(F.lit(f"{label}（"), shown("before", f), F.lit(" → "), shown("after", f), F.lit("）"))) for f, label in labels]
    return F.concat_ws("・", *parts, F.when(F.array_contains("fields", asset), asset_text))


def feed_items(changes: DataFrame, targets=rules.TARGETS) -> DataFrame:
    """Feed rows: target, target_label, name, type, summary, and the place: target order, kept rows before removed, ord."""
    labels = F.create_map(*(F.lit(x) for pair in targets for x in pair))
    places = F.create_map(*(F.lit(x) for i, (t, _) in enumerate(targets) for x in (t, i)))
    name = F.coalesce("after.name", "before.name")
    role = lambda side: F.when(F.coalesce(F.col(f"{side}.role"), F.lit("")) != "", F.concat(F.lit("（"), F.col(f"{side}.role"), F.lit("）"))).otherwise("")
    text = F.when(F.col("type") == "added", F.concat(name, role("after"), F.lit(" を一覧に追加しました"))).when(F.col("type") == "removed", F.concat(name, role("before"), F.lit(" を一覧から除外しました"))).otherwise(F.concat(name, F.lit("："), change_summary()))
    return changes.select("target", F.coalesce(F.try_element_at(labels, F.col("target")), F.col("target")).alias("target_label"), name.alias("name"), "type", text.alias("summary"), F.coalesce(F.try_element_at(places, F.col("target")), F.lit(len(targets))).alias("target_order"), (F.col("type") == "removed").cast("int").alias("removed_last"), "ord")


ITEM_ORDER = ("target_order", "target", "removed_last", "ord", "name")


def change_counts(items: DataFrame) -> DataFrame:
    """Added, removed, changed and total of each target with a change; over all items, whatever the feed shows."""
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    return items.groupBy("target").agg(n("added"), n("removed"), n("changed"), F.count("*").alias("total")).filter("total > 0")


def cap_feed(items: DataFrame, most: int = rules.FEED_ITEMS, with_reason: int = rules.FEED_REASONS) -> DataFrame:
    """The first ``most`` items with ``place`` from 1 and ``wants_reason`` (added or removed among the first few)."""
    few = items.orderBy(*ITEM_ORDER).limit(most)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ITEM_ORDER)))  # ``most`` rows
    return placed.withColumn("wants_reason", (F.col("place") <= with_reason) & (F.col("type") != "changed"))


def with_notices(items: DataFrame, notices: DataFrame) -> DataFrame:
    """Manual notices before computed items; ``source_rank`` keeps them apart."""
    return notices.withColumn("source_rank", F.lit(0)).unionByName(items.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def parse_rss(feeds: DataFrame, most: int = rules.FEED_ENTRIES) -> DataFrame:
    """Entries of RSS bodies (``url``, ``body``): the first ``most`` items of each that have title and link."""
    from kairan.functions.text import decode_entities

    items = feeds.select("url", F.posexplode(F.slice(F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)), 1, most)).alias("ord", "item"))
    raw = lambda tag: F.regexp_extract("item", rf"(?is)<{tag}>(.*?)</{tag}>", 1)
    out = items.select("url", "ord", html_text(raw("title")).alias("title"), decode_entities(raw("link")).alias("link"), html_text(raw("description")).alias("description"), decode_entities(raw("pubDate")).alias("pub_date"))
    source = F.when(F.col("title").contains(" - "), F.trim(F.element_at(F.split("title", " - "), -1))).otherwise("")
    return out.withColumn("source_title", source).filter("title <> '' and link <> ''")


def pick_reasons(items: DataFrame, entries: DataFrame, removed=rules.REMOVED_REASONS, added=rules.ADDED_REASONS, outlets: str = rules.OUTLETS) -> DataFrame:
    """The best reason of each item: ``item_id``, ``label``, ``confidence``, ``source_title``, ``link``, ``pub_date``.

    ``items`` has item_id and type, ``entries`` has item_id, ord, title, description, source_title, link, pub_date. An
    entry gives a pattern 4 points if it matches and 1 if it names an outlet; the most distinct sources win, then the
    score, then the reason met first; two sources confirm. The first entry of a reason is the one shown.
    """
    hay = F.concat_ws(" ", "title", "description")
    def options(table, offset):
        return F.array(*(F.struct(F.lit(i + offset).alias("at"), F.lit(label).alias("label"), hay.rlike(p).alias("hit")) for i, (_, label, p) in enumerate(table)))

    joined = entries.join(items.select("item_id", "type"), "item_id")
    scored = joined.withColumn("_o", F.explode(F.when(F.col("type") == "removed", options(removed, 0)).otherwise(options(added, 100))))
    points = F.when(F.col("_o.hit"), 4).otherwise(0) + F.when(hay.rlike(outlets), 1).otherwise(0)
    found = scored.withColumn("_p", points).filter("_p > 0")
    first = F.struct("ord", "source_title", "link", "pub_date")
    buckets = found.groupBy("item_id", F.col("_o.label").alias("label"), F.col("_o.at").alias("at")).agg(F.sum("_p").alias("score"), F.countDistinct(F.nullif(F.col("source_title"), F.lit(""))).alias("sources"), F.min(first).alias("entry"))
    w = Window.partitionBy("item_id").orderBy(F.desc("sources"), F.desc("score"), "entry.ord", "at")
    best = buckets.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return best.select("item_id", "label", F.when(F.col("sources") >= 2, "confirmed").otherwise("candidate").alias("confidence"), "score", "sources", "entry.source_title", "entry.link", "entry.pub_date")


def flag_recent(rows: DataFrame, items: DataFrame, target: str) -> DataFrame:
    """``recently_added``: the feed has an addition of this name for ``target``."""
    from kairan.functions.text import compact

    names = items.filter((F.col("target") == target) & (F.col("type") == "added")).select(compact(F.col("name")).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return rows.withColumn("_key", compact(F.col("name"))).join(names, "_key", "left").withColumn("recently_added", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")
