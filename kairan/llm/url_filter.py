"""URL filters: longest-rule verdicts, and a Bloom filter cascade for exact membership in a list, all in Spark SQL.

The first filter of the cascade holds the listed keys of the corpus. Keys of the corpus that pass it without being
listed are its false positives; the next filter holds these, the one after it the listed keys that pass that, and so
on, until none is wrong. Over all keys of the corpus the cascade's answer is then exact, and pages meet no list.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairan.sources.store import new_path

from .common import release, stored

#: Fixed rules: action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Domains whose pages are listed, with all subdomains.
LISTED_DOMAINS = ("cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org", "ads-track.example.org")
#: Share of false positives of every filter but the first, whose share leaves half as many of them as there are listed keys.
WRONG = 1 / 32
#: Bytes of a filter that goes to all tasks; a longer list is dealt by hash to several cascades, each for its own keys.
MOST_BYTES = 8_000_000
MOST_LEVELS = 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_raw_host(url), _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _raw_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def under(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain) if domain else F.lit(True)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits; null if none does."""
    name = action = F.lit(None).cast("string")
    for act, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = under(host, domain) & path.startswith(start)
        name, action = F.when(fits, domain + start).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


@dataclass
class Level:
    """A Bloom filter: a one-row table of its 64-bit ``words``, its number of bits and of hash functions."""

    words: DataFrame
    size: int
    hashes: int


def _bits(key: Column, level: int, size: int, hashes: int) -> list[Column]:
    one, two = F.pmod(F.xxhash64(F.lit(level), key), F.lit(size)), F.pmod(F.xxhash64(key, F.lit(-1 - level)), F.lit(size))
    return [F.pmod(one + F.lit(i) * two, F.lit(size)) for i in range(hashes)]


def _filter(keys: DataFrame, level: int, size: int, hashes: int) -> DataFrame:
    """One row, one array of 64-bit words: the Bloom filter of ``keys.key``; bits are merged by aggregation."""
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), level, size, hashes))).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("word")).join(bits, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def _passes(made: Level, key: Column, level: int) -> Column:
    test, words = F.lit(True), made.words.scalar()
    for at in _bits(key, level, made.size, made.hashes):
        test = test & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return test


def _shape(keys: int, wrong: float) -> tuple[int, int]:
    """Bits and hash functions of a filter of so many keys for a share of false positives."""
    hashes = max(1, round(math.log2(1 / wrong)))
    return 64 * max(1, math.ceil(keys * hashes / math.log(2) / 64)), hashes


def first_share(listed: int, others: int) -> float:
    """The first filter's share of false positives: at most half as many as there are listed keys, so that no later
    filter outgrows the list, however many other keys there are."""
    return min(WRONG, listed / (2 * max(1, others)))


def build_cascade(universe: DataFrame) -> list[Level]:
    """Filters for ``universe``: distinct ``key``, ``listed``.

    Levels alternate between listed and other keys; each level sees only the keys that the one before lets through.
    """
    levels: list[Level] = []
    inside, outside = stored(universe.filter("listed").select("key"), "listed"), stored(universe.filter("not listed").select("key"), "others")
    count, against = inside.count(), outside.count()
    while count:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("the cascade doesn't end: keys collide in every filter")
        level, (size, hashes) = len(levels), _shape(count, WRONG if levels else first_share(count, against))
        made = Level(stored(_filter(inside, level, size, hashes), f"bloom{level}"), size, hashes)
        levels.append(made)
        wrong = stored(outside.filter(_passes(made, F.col("key"), level)), f"wrong{level}")
        release(outside)
        inside, outside, count = wrong, inside, wrong.count()
    release(inside, outside)
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: it passes level 0, and not level 1 unless level 2, and so on."""
    answer = F.lit(False)
    for level in reversed(range(len(levels))):
        answer = _passes(levels[level], key, level) & ~answer
    return answer


def listed_pages(pages: DataFrame, domains: Sequence[str] = LISTED_DOMAINS, url_col: str = "url") -> DataFrame:
    """``key`` (host and path) of all pages of some domains, as a list for ``judge_urls``."""
    host, found = url_host(pages[url_col]), F.lit(False)
    for d in domains:
        found = found | under(host, d)
    return pages.filter(found).select(F.concat(host, url_path(pages[url_col])).alias("key")).distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (allow or block) of every page.

    The longest fitting rule decides; where none fits, a page is blocked if its key (host and path) is listed.
    ``listed`` has a column ``key``; nulls and repeats in it don't matter, nor do keys of no page. A null url, or one
    without ``://``, has empty host and path, fits no rule and is allowed unless the empty key is listed. Rows are
    judged one by one, so repeated rows repeat; a null id stays null; an empty table gives no rows; other columns
    aren't read. A list whose filter would exceed ``most_bytes`` is dealt by hash of the key: every part of the pages
    then meets its own, smaller cascade.
    """
    url = pages[url_col]
    parted = pages.select(pages[id_col].alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path")).withColumn("key", F.concat("host", "path"))
    on_list = listed.filter("key is not null").select("key").distinct().withColumn("listed", F.lit(True))
    universe = stored(parted.select("key").distinct().join(on_list, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    sizes = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, others = sizes.get(True, 0), sizes.get(False, 0)
    parts = max(1, math.ceil(_shape(inside, first_share(inside, others))[0] / 8 / most_bytes)) if inside else 1
    if parts == 1:
        tested = parted.withColumn("listed", in_cascade(build_cascade(universe), F.col("key")))
    else:
        part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(parts)).alias("part")
        path = new_path(pages.sparkSession, "parts")
        parted.select("*", part).write.partitionBy("part").parquet(path)
        dealt, tested = pages.sparkSession.read.schema(parted.select("*", part).schema).parquet(path), None
        for k in range(parts):
            levels = build_cascade(universe.filter(part == k))
            one = dealt.filter(F.col("part") == k).drop("part").withColumn("listed", in_cascade(levels, F.col("key")))
            tested = one if tested is None else tested.unionByName(one)
    release(universe)
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return tested.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


#: DuckDB SQL of ``judge_urls`` for the default rules and the pages of the default domains.
SQL = """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parted)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN len(list_filter(['cheap-pills.example.com', 'free-bets.example.com', 'spam-farm.example.org', 'ads-track.example.org'], lambda d: host = d OR ends_with(host, '.' || d))) > 0 THEN 'block'
  ELSE 'allow' END AS verdict FROM ruled"""
