"""Linking names to assets: exact, variant, several keys, aliases, containment, nearness, position; ranking of links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairan.functions.text import compact_name, name_aliases, plain_text, variant_key
from kairan.operators.containing import finder
from kairan.operators.ranking import best_per, dedup_keep

#: Candidates of a key that go to a reviewer.
CANDIDATES = 20


def _has(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)) != "", F.lit(False))


def fill_by_key(rows: DataFrame, pool: DataFrame, row_key: Column, pool_key: Column, image: str = "image", keep: str = "first") -> DataFrame:
    """Rows without an asset take the pool's by equal key; the first (or last) pool row of a key counts. ``outcome`` tells."""
    known = dedup_keep(pool.select(pool_key.alias("_key"), F.col(image).alias("_image"), "ord").filter("_key <> '' and _image <> ''"), ["_key"], ["ord"], keep).drop("ord")
    joined = rows.withColumn("_key", row_key).join(known, "_key", "left")
    outcome = F.when(_has(image), "already").when(F.col("_key") == "", "no-key").when(F.col("_image").isNull(), "none").otherwise("matched")
    return joined.withColumn("outcome", outcome).withColumn(image, F.when(_has(image), F.col(image)).otherwise(F.col("_image"))).drop("_key", "_image")


def match_variants(rows: DataFrame, pairs: DataFrame, on_many: str = "review", key: str = "name", image: str = "image", most: int = CANDIDATES) -> DataFrame:
    """Rows without an asset meet candidates of an equal variant key: none, one (filled), more (``review`` with arrays).

    Candidates are first reduced to one row a key: their number and the first ``most`` of them, so a common key costs
    one row of bounded size in the join. ``n_candidates`` is the whole number. ``on_many='first'`` takes the first
    candidate instead.
    """
    distinct = dedup_keep(pairs.select(F.col(key).alias("_name"), F.col("url").alias("_url"), F.col(image).alias("_image"), "ord"), ["_name", "_url", "_image"], ["ord"])
    keyed = distinct.withColumn("_key", variant_key(F.col("_name"))).filter("_key <> ''")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    first = Window.partitionBy("_key").orderBy("ord", "_name", "_url", "_image")
    few = keyed.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= most).groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_image"))), lambda x: x["_image"]).alias("_c"))
    joined = rows.withColumn("_key", variant_key(F.col(key))).join(counts.join(few, "_key"), "_key", "left")
    one = (F.col("_n") == 1) | ((F.col("_n") > 1) & F.lit(on_many == "first"))
    outcome = F.when(_has(image), "already").when(F.col("_key") == "", "no-key").when(F.col("_n").isNull(), "none").when(one, "matched").otherwise("ambiguous")
    out = joined.withColumn("outcome", outcome)
    taken, many = F.col("outcome") == "matched", F.col("outcome") == "ambiguous"
    filled = F.when(taken, F.col("_c")[0]).otherwise(F.col(image))
    status = F.when(many, "review").when(taken | (F.col("outcome") == "already"), "ok").otherwise("missing")
    listed = F.when(many, F.col("_c")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({image: filled, "image_status": status, "image_candidates": listed, "n_candidates": F.when(many, F.col("_n")).otherwise(F.lit(0).cast("long"))}).drop("_key", "_n", "_c")


def match_by_keys(rows: DataFrame, pool: DataFrame, key_array: Column, id_col: str, pool_id: str = "id", image: str = "image") -> DataFrame:
    """The first key of an ordered array that the pool has (upper case): ``id_col``, ``matched_key``, ``image``."""
    keys = rows.select(id_col, F.posexplode(F.array_distinct(F.filter(F.transform(key_array, lambda x: F.upper(F.trim(x))), lambda x: x != ""))).alias("pos", "_key"))
    known = dedup_keep(pool.select(F.upper(F.trim(pool_id)).alias("_key"), F.col(image).alias("_image"), "ord"), ["_key"], ["ord"]).drop("ord")
    found = keys.join(known, "_key").groupBy(id_col).agg(F.min_by(F.struct("_key", "_image"), "pos").alias("_m"))
    return rows.select(id_col).join(found, id_col, "left").select(id_col, F.col("_m._key").alias("matched_key"), F.col("_m._image").alias(image))


def resolve_person(rows: DataFrame, people: DataFrame, fields: tuple[str, ...] = ("image",)) -> DataFrame:
    """Fields of people by compact name (first with an asset), else by (chamber, kana) where that means one person."""
    named = dedup_keep(people.filter(_has("image")).withColumn("_key", compact_name(F.col("name"))), ["_key"], ["ord"]).select("_key", F.struct(*fields).alias("_by_name"))
    alike = people.filter("kana <> '' and chamber <> ''").groupBy("chamber", "kana").agg(F.countDistinct(F.struct(compact_name(F.col("name")))).alias("_n"), F.min_by(F.struct(*fields), "ord").alias("_by_kana")).filter("_n = 1").drop("_n")
    joined = rows.drop(*fields).withColumn("_key", compact_name(F.col("name"))).join(named, "_key", "left").join(alike, ["chamber", "kana"], "left")
    pick = F.coalesce("_by_name", "_by_kana")
    return joined.withColumns({f: pick[f] for f in fields}).withColumn("resolved_by", F.when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_kana").isNotNull(), "kana").otherwise("none")).drop("_key", "_by_name", "_by_kana")


def match_aliases(mentions: DataFrame, entities: DataFrame, mention_aliases: Column | None = None, entity_aliases: Column | None = None, many: bool = False) -> DataFrame:
    """``mention_id``, ``entity_id`` that share an alias; without ``many`` only mentions of exactly one entity.

    For exactly one, an alias needs only its least and greatest entity: entities are reduced to a row an alias before
    the join, and a mention has one entity if the least and the greatest of its aliases are the same.
    """
    a = mentions.select("mention_id", F.explode(F.array_distinct(mention_aliases if mention_aliases is not None else name_aliases(F.col("text")))).alias("alias"))
    b = entities.select("entity_id", F.explode(F.array_distinct(entity_aliases if entity_aliases is not None else name_aliases(F.col("name")))).alias("alias"))
    if many:
        return a.join(b, "alias").select("mention_id", "entity_id").distinct()
    ends = b.groupBy("alias").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    found = a.join(ends, "alias").groupBy("mention_id").agg(F.min("lo").alias("entity_id"), F.max("hi").alias("_hi"))
    return found.filter("entity_id = _hi").select("mention_id", "entity_id")


def _named(found: DataFrame, by: list[str], names: DataFrame, unique: bool) -> DataFrame:
    """Rows of candidates ``key`` joined with the names: ``by`` and ``entity_id``; with ``unique`` of one entity only.

    For exactly one, a key needs only its least and greatest entity. A key that many rows hold meets one row of names,
    and a hot one's rows are split by the adaptive join.
    """
    if not unique:
        return found.join(names.select("key", "entity_id").distinct(), "key").select(*by, "entity_id").distinct()
    ends = names.groupBy("key").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    met = found.join(ends, "key").groupBy(*by).agg(F.min("lo").alias("entity_id"), F.max("hi").alias("_hi"))
    return met.filter("entity_id = _hi").select(*by, "entity_id")


def link_contained(texts: DataFrame, names: DataFrame, unique: bool = True) -> DataFrame:
    """``text_id``, ``entity_id`` of texts that contain an entity's key; with ``unique`` exactly one entity's.

    ``texts`` has text_id, text; ``names`` has entity_id, key; empty and null keys and texts match nothing. Texts are
    read once, whatever the number of names; each gives the distinct stretches that may be names (see ``containing``),
    which are joined with the names.
    """
    base, index = texts.select("text_id", "text"), texts.sparkSession.sparkContext.broadcast(finder(names))
    schema = T.StructType([base.schema["text_id"], T.StructField("key", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(batch.column(1)):
                found = index.value.candidates(text.as_py() or "")
                rows += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string())], ["text_id", "key"])

    return _named(base.mapInArrow(search, schema), ["text_id"], names, unique)


def _windows(html: str, pattern: re.Pattern, radius: int) -> Iterator[tuple[int, str, str]]:
    """Number, text and surroundings (as plain text) of each match."""
    for pos, m in enumerate(pattern.finditer(html)):
        yield pos, m.group(), plain_text(html[max(0, m.start() - radius) : m.end() + radius])


def _each_window(pages: DataFrame, pattern: str, radius: int, body: str, tell, last: str) -> DataFrame:
    """``page_id``, ``pos``, ``url_hit`` and each of what ``tell`` makes of the surroundings of each match."""
    kind = pages.schema["page_id"]
    schema = T.StructType([kind, *T.StructType.fromDDL(f"pos int, url_hit string, {last} string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, made = re.compile(pattern), tell()
        for batch in batches:
            for i, html in enumerate(batch.column(1)):
                rows = ((pos, hit, x) for pos, hit, around in _windows(html.as_py() or "", compiled, radius) for x in made(around))
                while some := list(islice(rows, 10_000)):
                    page = batch.column(0).take(pa.array([i] * len(some)))
                    yield pa.RecordBatch.from_arrays([page, *(pa.array(x, t) for x, t in zip(zip(*some, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True))], ["page_id", "pos", "url_hit", last])

    return pages.select("page_id", body).mapInArrow(run, schema)


def windows_of_text(pages: DataFrame, pattern: str, radius: int = 1200, body: str = "html") -> DataFrame:
    """``pos``, ``url_hit`` and the plain ``text`` within ``radius`` characters of each match of ``pattern`` (group 0)."""
    return _each_window(pages, pattern, radius, body, lambda: lambda around: (around,), "text")


def link_near(pages: DataFrame, names: DataFrame, pattern: str, radius: int = 1200, body: str = "html") -> DataFrame:
    """``page_id``, ``pos``, ``url_hit``, ``entity_id``: the one entity named around each hit.

    A page's hits are gone through once, in order; their surroundings are searched where they are, and only the keys
    that they may hold leave the task. Names and surroundings count as their plain text.
    """
    index = pages.sparkSession.sparkContext.broadcast(finder(names))
    found = _each_window(pages, pattern, radius, body, lambda: index.value.candidates, "key")
    return _named(found, ["page_id", "pos", "url_hit"], names, True)


def zip_by_position(a: DataFrame, b: DataFrame, key: str = "ord") -> DataFrame:
    """Rows at equal positions; an error at run time if ``b`` is shorter."""
    joined = a.join(b.withColumn("_there", F.lit(True)), key, "left")
    return joined.filter(F.when(F.col("_there").isNull(), F.raise_error(F.lit("the second list is shorter"))).otherwise(F.lit(True))).drop("_there")


def merge_candidates(df: DataFrame, candidates: str, pages: str, direct: str, image: str = "image") -> DataFrame:
    """Ordered distinct union of two URL arrays; a direct asset fills a blank one and comes first."""
    fills = ~_has(image) & _has(direct)
    none = F.array().cast("array<string>")
    merged = F.concat(F.when(fills, F.array(direct)).otherwise(none), F.coalesce(candidates, none), F.coalesce(pages, none))
    return df.withColumn(candidates, F.array_distinct(F.filter(merged, lambda x: x.isNotNull() & (x != "")))).withColumn(image, F.when(fills, F.col(direct)).otherwise(F.col(image)))


def rank_candidates(cands: DataFrame, entity: str, url: str, score: str, k: int = 5) -> DataFrame:
    """Per entity its ``k`` best distinct URLs as an array; applied only if there is exactly one, else review."""
    best = best_per(cands, [entity, url], F.col(score), ["ord"])
    counts = best.groupBy(entity).agg(F.count("*").alias("n_urls"))
    w = Window.partitionBy(entity).orderBy(F.desc(score), "ord", url)
    top = best.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    lists = top.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", url))), lambda x: x[url]).alias("candidates"))
    return lists.join(counts, entity).withColumn("status", F.when(F.col("n_urls") == 1, "applied").otherwise("review"))


def resolve_by_priority(cands: DataFrame, entity: str, source: str, order: tuple[str, ...], current: DataFrame | None = None, url: str = "url") -> DataFrame:
    """The acceptable candidate of the first source in ``order``; with ``current`` (fix mode) an entity's present URL isn't."""
    from kairan.functions.urls import normalize_url

    ranks = F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i)))
    good = cands.filter(_has(url)).withColumn("_rank", F.coalesce(F.try_element_at(ranks, F.col(source)), F.lit(len(order))))
    if current is not None:
        now = current.select(entity, normalize_url(F.col("image")).alias("_now"))
        good = good.join(now, entity, "left").filter(~((F.col("_now") != "") & F.col("_now").eqNullSafe(normalize_url(F.col(url))))).drop("_now")
    return dedup_keep(good, [entity], ["_rank", "ord"]).drop("_rank")


def match_report(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Rows of each outcome."""
    return df.groupBy(outcome).agg(F.count("*").alias("n"))

