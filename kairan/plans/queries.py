"""Registered queries of the roster library, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairan.functions import memory, rules, text, urls
from kairan.operators import assets, diff, learning, linking, markup, quality, ranking, roster
from kairan.plans.base import ASSETS, CURR, GRADES_DUCK, NOW, PEOPLE, PREV, derived, grades
from kairan.sources import files
from kairan.sources.store import new_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def curr(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, CURR, "customer", "supplier")


def prev(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, PREV, "customer", "supplier")


def people(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, PEOPLE, "customer").withColumnRenamed("grp", "group")


def asset_rows(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, ASSETS, "customer")


def read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


# ---- change feed -------------------------------------------------------------------------------------------------
_DIFF = f"""WITH p AS ({PREV}), c AS ({CURR}),
j AS (SELECT coalesce(c.target, p.target) AS target, coalesce(c.key, p.key) AS key, coalesce(c.ord, p.ord) AS ord, c.name AS n2, p.name AS n1, p.party AS p1, c.party AS p2, p.image AS i1, c.image AS i2, p.role AS r1, c.role AS r2, CASE WHEN p.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' ELSE 'changed' END AS type FROM p FULL JOIN c ON p.target = c.target AND p.key = c.key),
x AS (SELECT *, concat_ws('・', CASE WHEN type = 'changed' AND p1 <> p2 THEN concat('所属変更（', p1, ' → ', p2, '）') END, CASE WHEN type = 'changed' AND i1 <> i2 THEN '顔写真を更新' END) AS parts FROM j),
items AS (SELECT target, key, ord, coalesce(n2, n1) AS name, type, CASE type WHEN 'added' THEN concat(n2, '（', r2, '） を一覧に追加しました') WHEN 'removed' THEN concat(n1, '（', r1, '） を一覧から除外しました') ELSE concat(n2, '：', parts) END AS summary, CASE target WHEN 'senators' THEN 0 ELSE 1 END AS target_order, CASE WHEN type = 'removed' THEN 1 ELSE 0 END AS removed_last, CASE WHEN type = 'changed' THEN list_filter([CASE WHEN p1 <> p2 THEN 'party' END, CASE WHEN i1 <> i2 THEN 'image' END], lambda f: f IS NOT NULL) ELSE [] END AS fields FROM x WHERE type <> 'changed' OR parts <> '')
"""


def _changes(s, d):
    return diff.diff_snapshots(prev(s, d), curr(s, d))


@query("change_feed", _DIFF + "SELECT target, name, type, summary, target_order, removed_last, ord FROM items")
def change_feed(s, d):
    """Diff, sentences and places of all changes between two snapshots."""
    return diff.feed_items(_changes(s, d)).drop("target_label")


@query("snapshot_diff", _DIFF + "SELECT target, key, type, CASE WHEN type = 'changed' THEN array_to_string(fields, ',') END AS fields FROM items")
def snapshot_diff(s, d):
    """The difference of two snapshots that were published in buckets of their keys: no shuffle is left."""
    path = new_path(s, "buckets")
    sides = [files.bucketed_snapshot(df, f"kairan_{n}_{path[-32:]}", f"{path}/{n}") for n, df in (("prev", prev(s, d)), ("curr", curr(s, d)))]
    return diff.diff_snapshots(*sides).select("target", "key", "type", F.when(F.col("type") == "changed", F.array_join("fields", ",")).alias("fields"))


@query("change_counts", _DIFF + "SELECT target, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'removed') AS removed, count(*) FILTER (type = 'changed') AS changed, count(*) AS total FROM items GROUP BY target")
def change_counts(s, d):
    return diff.change_counts(diff.feed_items(_changes(s, d)))


@query("capped_feed", _DIFF + "SELECT place, name, type, place <= 12 AND type <> 'changed' AS wants_reason FROM (SELECT *, row_number() OVER (ORDER BY target_order, target, removed_last, ord, name) AS place FROM items) WHERE place <= 80")
def capped_feed(s, d):
    return diff.cap_feed(diff.feed_items(_changes(s, d))).select("place", "name", "type", "wants_reason")


@query("feed_document", _DIFF + ", few AS (SELECT *, row_number() OVER (ORDER BY target_order, target, removed_last, ord, name) AS place FROM items QUALIFY place <= 80) SELECT '2024-01-01T00:00:00Z' AS generated_at, count(*) AS total_changes, true AS has_updates, count(DISTINCT target) AS n_targets, string_agg(name, ',' ORDER BY place) AS names FROM few")
def feed_document(s, d):
    items = diff.cap_feed(diff.feed_items(_changes(s, d))).withColumnRenamed("place", "at")
    counts = diff.change_counts(items).withColumn("ord", F.col("target"))
    feed = files.build_feed(items.select(F.col("at").alias("ord"), "target", "name", "type", "summary"), counts, "2024-01-01T00:00:00Z")
    return feed.select(F.col("generatedAt").alias("generated_at"), F.col("totalChanges").alias("total_changes"), F.col("hasUpdates").alias("has_updates"), F.size("summaries").cast("long").alias("n_targets"), F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("names"))


@query("feed_with_notices", _DIFF + "SELECT 1 AS source_rank, target, name, type, summary FROM items UNION ALL SELECT 0, 'notice', n_name, NULL, concat('nation ', cast(n_nationkey AS string)) FROM nation")
def feed_with_notices(s, d):
    notices = read(s, d, "nation").select(F.lit("notice").alias("target"), F.col("n_name").alias("name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("summary"))
    return diff.with_notices(diff.feed_items(_changes(s, d)), notices).select("source_rank", "target", "name", "type", "summary")


@query("recently_added", _DIFF + f"SELECT c.name, EXISTS (SELECT 1 FROM items i WHERE i.target = 'senators' AND i.type = 'added' AND i.name = c.name) AS recently_added FROM ({CURR}) c WHERE c.target = 'senators'")
def recently_added(s, d):
    return diff.flag_recent(curr(s, d).filter("target = 'senators'"), diff.feed_items(_changes(s, d)), "senators").select("name", "recently_added")


_PATTERNS = (("a", "reason a", "trash|idiot"), ("b", "reason b", "the|und"), ("c", "reason c", "eau|que"))


@query("change_reasons", """WITH e AS (SELECT doc_id % 50 AS item_id, doc_id AS ord, source AS source_title, text FROM documents),
s AS (SELECT *, unnest([{'spot': 0, 'label': 'reason a', 'hit': regexp_matches(text, 'trash|idiot')}, {'spot': 1, 'label': 'reason b', 'hit': regexp_matches(text, 'the|und')}, {'spot': 2, 'label': 'reason c', 'hit': regexp_matches(text, 'eau|que')}]) AS o, regexp_matches(text, 'License') AS outlet FROM e),
b AS (SELECT item_id, o.label AS label, o.spot AS spot, sum(CASE WHEN o.hit THEN 4 ELSE 0 END + CASE WHEN outlet THEN 1 ELSE 0 END) AS score, count(DISTINCT nullif(source_title, '')) AS sources, min(ord) AS first_ord, arg_min(source_title, ord) AS source_title FROM s WHERE o.hit OR outlet GROUP BY ALL)
SELECT item_id, label, CASE WHEN sources >= 2 THEN 'confirmed' ELSE 'candidate' END AS confidence, CAST(score AS BIGINT) AS score, sources, source_title FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sources DESC, score DESC, first_ord, spot) = 1""")
def change_reasons(s, d):
    entries = read(s, d, "documents").select((F.col("doc_id") % 50).alias("item_id"), F.col("doc_id").alias("ord"), F.lit("").alias("title"), F.col("text").alias("description"), F.col("source").alias("source_title"), F.lit("").alias("link"), F.lit("").alias("pub_date"))
    items = entries.select("item_id").distinct().withColumn("type", F.lit("removed"))
    return diff.pick_reasons(items, entries, removed=_PATTERNS, outlets="License").select("item_id", "label", "confidence", "score", "sources", "source_title")


@query("rss_entries", """WITH i AS (SELECT concat(source, '/', CAST(doc_id // 100 AS VARCHAR)) AS url, doc_id, concat('T', regexp_replace(coalesce(text, ''), '[^A-Za-z]', 'x', 'g')) AS t FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS n FROM i)
SELECT url, concat(t, ' - ', url) AS title, concat('https://n.example/', doc_id) AS link, url AS source_title FROM r WHERE n <= 8 AND doc_id % 3 <> 0""")
def rss_entries(s, d):
    """A feed for each source and hundred documents, with their whole texts as titles."""
    url = F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    item = F.concat(F.lit("<item><title><![CDATA[T"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "x"), F.lit(" - "), url, F.lit("]]></title><link>"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string"))).otherwise(""), F.lit("</link></item>"))
    feeds = read(s, d, "documents").groupBy(url.alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]), "").alias("body"))
    return diff.parse_rss(feeds).select("url", "title", "link", "source_title")


# ---- text functions ----------------------------------------------------------------------------------------------
_BARE = "regexp_replace(regexp_replace(name, '[ 　]', '', 'g'), '（.*?）|\\(.*?\\)', '', 'g')"


@query("name_keys", f"""SELECT id, regexp_replace(name, '[ 　]+', '', 'g') AS compacted, regexp_replace(regexp_replace(regexp_replace(name, '　', ' ', 'g'), '[（(][^）)]*[）)]', '', 'g'), '君$', '') AS plain, regexp_replace(regexp_replace(name, '[（(][^）)]*[）)]', '', 'g'), '[ 　]+', '', 'g') AS compact_plain, {_BARE} AS key1, translate({_BARE}, '髙邊邉澤廣', '高辺辺沢広') AS variant, CASE WHEN name LIKE '%（%' THEN 'やまだたろう' WHEN name LIKE '%(%' THEN 'サトウ' ELSE '' END AS kana, CASE WHEN name LIKE '%（%' THEN 'やまだたろう' WHEN name LIKE '%(%' THEN 'さとう' ELSE '' END AS hira FROM ({PEOPLE})""")
def name_keys(s, d):
    n, split = F.col("name"), text.split_name_kana(F.col("name"))
    return people(s, d).select("id", text.compact(n).alias("compacted"), text.plain_name(n).alias("plain"), text.compact_name(n).alias("compact_plain"), text.match_key(n).alias("key1"), text.variant_key(n).alias("variant"), split["kana"].alias("kana"), text.to_hiragana(split["kana"]).alias("hira"))


@query("width_keys", "SELECT o_orderkey, concat('Ab-', cast(o_orderkey AS string), ' x') AS half, concat('Ab', cast(o_orderkey AS string), 'x') AS key2 FROM orders")
def width_keys(s, d):
    wide = F.concat(F.lit("Ａｂ－"), F.translate(F.col("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("　ｘ"))
    return read(s, d, "orders").select("o_orderkey", text.to_halfwidth(wide).alias("half"), text.nfkc_key(wide).alias("key2"))


@query("stable_ids", "SELECT p_partkey, 10000000 + list_reduce(list_transform(string_split(concat(p_brand, ':', p_type, ':', p_name, '山'), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 131 + c) % 90000000, CAST(0 AS BIGINT)) AS id FROM part")
def stable_ids(s, d):
    return read(s, d, "part").select("p_partkey", text.stable_id(F.col("p_brand"), F.col("p_type"), F.concat("p_name", F.lit("山"))).alias("id"))


@query("labels_and_ranks", f"""SELECT id, CASE WHEN district LIKE '%比例%' THEN 9999 WHEN district LIKE '%北海道%' THEN 0 WHEN district LIKE '%東京%' THEN 12 WHEN district LIKE '%新潟%' THEN 14 ELSE 9998 END AS rank, CASE era WHEN '令和7年' THEN 2025 WHEN '2028年' THEN 2028 WHEN '令和１０年' THEN 2028 END AS year, CASE ord % 4 WHEN 0 THEN '総理' WHEN 1 THEN '文科政務官 / 厚労副大臣' WHEN 2 THEN '' ELSE '沖縄北方特別委員長' END AS short_role, CASE party WHEN 'BUILDING' THEN 'B' ELSE party END AS label FROM ({PEOPLE})""")
def labels_and_ranks(s, d):
    return people(s, d).select("id", text.district_rank(F.col("district")).alias("rank"), text.era_year(F.col("era")).alias("year"), text.shorten_role(F.col("role")).alias("short_role"), text.expand_label(F.col("party"), {"BUILDING": "B"}).alias("label"))


@query("alias_sets", None)
def alias_sets(s, d):
    return people(s, d).select("id", F.array_join(text.name_aliases(F.col("name")), ",").alias("aliases"))


@query("cell_shapes", f"SELECT id, name NOT SIMILAR TO '.*[0-9].*' AS name_like, coalesce(regexp_full_match(cast(terms AS string), '[0-9]{{1,2}}'), false) AS wins_like, id % 3 = 0 AS kana_like, coalesce(party IN ('BUILDING', 'MACHINERY'), false) AS party_like FROM ({PEOPLE})")
def cell_shapes(s, d):
    reading = F.when(F.col("id") % 3 == 0, "やまだ　たろー").otherwise(F.col("name"))
    return people(s, d).select("id", text.is_name_like(F.col("name")).alias("name_like"), text.is_wins_like(F.col("terms").cast("string")).alias("wins_like"), text.is_kana_like(reading).alias("kana_like"), text.is_party_like(F.col("party"), "^(BUILDING|MACHINERY)$").alias("party_like"))


@query("urls_cleaned", """SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, concat(regexp_extract(url, '^(.*://[^/?#]*)', 1), '/k/', cast(page_id AS string), '.jpg') AS above, regexp_extract(url, '://([^/?#]*)', 1) AS host, ends_with(regexp_extract(url, '://([^/?#]*)', 1), '.example.org') OR regexp_extract(url, '://([^/?#]*)', 1) = 'example.org' AS listed, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number FROM pages""")
def urls_cleaned(s, d):
    above = F.concat(F.lit("../../../k/./x/../"), F.col("page_id").cast("string"), F.lit(".jpg?v=1"))
    return read(s, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("clean"), urls.normalize_url(above, F.col("url")).alias("above"), urls.host(F.col("url")).alias("host"), urls.in_domains(F.col("url"), ["example.org"]).alias("listed"), urls.id_from_url(F.col("url"), "/([0-9]+)").alias("number"))


@query("profile_assets", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN concat('https://www.sangiin.go.jp/japanese/joho1/kousei/giin/photo/g', s_suppkey, '.jpg') END AS asset FROM supplier")
def profile_assets(s, d):
    profile = F.concat(F.lit("https://s.example/profile/"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "x.htm").otherwise(".htm"))
    return read(s, d, "supplier").select("s_suppkey", urls.asset_url_from_profile(profile, *rules.UPPER_PROFILE).alias("asset"))


@query("page_text", """SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages""")
def page_text(s, d):
    return read(s, d, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


# ---- roster ------------------------------------------------------------------------------------------------------
@query("normalized_people", f"""SELECT id, CASE WHEN name LIKE '%（%' THEN split_part(name, '（', 1) WHEN name LIKE '%(%' THEN split_part(name, '(', 1) ELSE name END AS name, CASE WHEN name LIKE '%（%' THEN 'やまだたろう' WHEN name LIKE '%(%' THEN 'サトウ' ELSE '' END AS kana, coalesce(nullif(party, ''), grp, nullif(role, ''), '') AS party, CASE WHEN terms > 0 THEN terms END AS terms FROM ({PEOPLE})""")
def normalized_people(s, d):
    return roster.normalize_person(people(s, d)).select("id", "name", "kana", "party", "terms")


@query("derived_kana", f"SELECT id, CASE WHEN ord % 2 = 0 THEN concat('k', cast(ord AS string)) ELSE '' END AS kana FROM ({CURR}) WHERE target = 'senators'")
def derived_kana(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    lookup = rows.filter("ord % 2 = 0").select("name", F.concat(F.lit("k "), F.col("ord").cast("string")).alias("kana"))
    return roster.derive_kana(rows, lookup).select("id", "kana")


@query("group_sizes", f"SELECT coalesce(nullif(party, ''), grp, '無所属') AS label, count(*) AS n FROM ({PEOPLE}) GROUP BY 1")
def group_sizes(s, d):
    return roster.group_sizes(people(s, d), roster.group_label())


@query("group_filter", f"SELECT id FROM ({PEOPLE}) WHERE coalesce(nullif(party, ''), grp, '無所属') IN ('BUILDING', '無所属')")
def group_filter(s, d):
    return roster.filter_group(people(s, d), ["BUILDING", "無所属"], roster.group_label()).select("id")


@query("roster_search", f"SELECT id FROM ({PEOPLE}) WHERE name LIKE '%沢%' OR lower(party) LIKE '%沢%' OR role LIKE '%沢%'")
def roster_search(s, d):
    return roster.search(people(s, d), " 沢 ", ["name", "party", "terms"], role_col="role").select("id")


@query("family_names", f"SELECT id, split_part(name, '　', 1) AS family, count(*) OVER (PARTITION BY split_part(name, '　', 1)) > 1 AS collides, concat(CASE WHEN count(*) OVER (PARTITION BY split_part(name, '　', 1)) > 1 THEN name ELSE split_part(name, '　', 1) END, '副大臣') AS shown FROM ({PEOPLE})")
def family_names(s, d):
    out = roster.name_collisions(people(s, d), roster.family_name(F.col("name")), ["target"])
    return out.select("id", "family", "collides", roster.display_name(out, "viceMinisters", "entrance").alias("shown"))


@query("answer_lines", f"""WITH p AS (SELECT id, name, coalesce(nullif(party, ''), grp, '') AS g, trim(regexp_replace(coalesce(nullif(role, ''), grp, nullif(party, ''), ''), '\\s*/\\s*(参議院|衆議院)$', '')) AS r FROM ({PEOPLE})),
l AS (SELECT id, 'senators' AS target, 'entrance' AS mode, [g] AS lines FROM p UNION ALL SELECT id, 'ministers', 'entrance', [CASE WHEN r <> '' THEN r ELSE g END] FROM p UNION ALL SELECT id, 'viceMinisters', 'entrance', [name, CASE WHEN r <> '' THEN r ELSE g END] FROM p UNION ALL SELECT id, 'senators', 'review', [CASE WHEN g <> '' THEN g ELSE name END] FROM p UNION ALL SELECT id, 'ministers', 'review', [CASE WHEN r <> '' THEN r WHEN g <> '' THEN g ELSE name END] FROM p)
SELECT id, target, mode, array_to_string(list_filter(lines, lambda x: x <> ''), '|') AS lines FROM l""")
def answer_lines(s, d):
    """The answer's lines for several kinds of roster and both modes."""
    rows, out = people(s, d).withColumns({"kana": F.lit(""), "sub_role": F.lit("")}), None
    for target, mode in (("senators", "entrance"), ("ministers", "entrance"), ("viceMinisters", "entrance"), ("senators", "review"), ("ministers", "review")):
        one = rows.select("id", F.lit(target).alias("target"), F.lit(mode).alias("mode"), F.array_join(roster.answer_lines(target, mode), "|").alias("lines"))
        out = one if out is None else out.unionByName(one)
    return out


@query("holders_excluded", f"SELECT c.id FROM ({CURR}) c WHERE c.target = 'senators' AND c.ord % 10 <> 0 AND NOT (c.ord % 7 = 0 AND c.ord % 2 = 0)")
def holders_excluded(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    as_people = rows.withColumns({"group": F.lit(""), "sub_role": F.lit(""), "chamber": F.when(F.col("ord") % 2 == 0, "参議院").otherwise("衆議院")})
    related = {"councilorsOfficersList": rows.filter("ord % 10 = 0"), "ministers": as_people.filter("ord % 7 = 0")}
    return roster.exclude_holders(rows, related, "senators").select("id")


@query("merged_roster", f"""WITH n AS (SELECT name, party, district, ord FROM ({CURR}) WHERE target = 'senators' AND id % 5 <> 0), o AS (SELECT name, party, district, ord FROM ({CURR}) WHERE target = 'senators' AND id % 3 <> 0)
SELECT coalesce(n.name, o.name) AS name, coalesce(nullif(CASE WHEN n.ord % 4 = 0 THEN '' ELSE n.party END, ''), o.party) AS party, coalesce(n.district, o.district) AS district, CASE WHEN n.name IS NULL THEN 'seed' ELSE 'live' END AS source_mode FROM n FULL JOIN o ON n.name = o.name""")
def merged_roster(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    new = rows.filter("id % 5 <> 0").select("name", F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("party")).alias("party"), "district", "ord")
    return roster.merge_keep(new, rows.filter("id % 3 <> 0").select("name", "party", "district", "ord"), ["name"]).select("name", "party", "district", "source_mode")


@query("enriched_roster", f"SELECT id, CASE WHEN ord % 3 = 0 THEN 'second' WHEN ord % 2 = 0 THEN 'first' ELSE district END AS district FROM ({CURR}) WHERE target = 'senators'")
def enriched_roster(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    a, b = (rows.filter(f"ord % {k} = 0").withColumn("district", F.lit(v)) for k, v in ((2, "first"), (3, "second")))
    return roster.enrich(rows, [a, b], ("district",)).select("id", "district")


@query("overridden_roster", f"SELECT id, CASE WHEN ord % 6 = 0 THEN 'over' ELSE party END AS party, CASE WHEN ord % 6 = 0 THEN 'override' ELSE role END AS role FROM ({CURR}) WHERE target = 'senators'")
def overridden_roster(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    over = rows.filter("ord % 3 = 0").select("target", "id", "ord", F.when(F.col("ord") % 6 == 0, "over").otherwise(" ").alias("party"))
    return roster.apply_overrides(rows, over, ["target", "id"], ("party",), ("role", "override")).select("id", "party", "role")


@query("carried_forward", f"SELECT id, CASE WHEN ord % 2 = 0 THEN image WHEN ord % 3 = 0 THEN concat('old', cast(ord AS string)) ELSE NULL END AS image FROM ({CURR}) WHERE target = 'senators'")
def carried_forward(s, d):
    rows = curr(s, d).filter("target = 'senators'")
    new = rows.withColumn("image", F.when(F.col("ord") % 2 == 0, F.col("image")).otherwise(""))
    old = rows.filter("ord % 3 = 0").withColumn("image", F.concat(F.lit("old"), F.col("ord").cast("string")))
    return roster.carry_forward(new, old, ("image",)).select("id", "image")


@query("assigned_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE (SELECT max(o_orderkey) FILTER (o_orderkey % 4 = 0) FROM orders) + count(*) FILTER (o_orderkey % 4 <> 0) OVER (ORDER BY o_orderkey) END AS id FROM orders")
def assigned_ids(s, d):
    rows = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("id"))
    return roster.assign_ids(rows, "id", ["o_orderkey"])


@query("chosen_route", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS route FROM customer")
def chosen_route(s, d):
    """Neither route is complete, so both are taken, the first route's rows before the second's of the same id."""
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"))
    n = rows.count()
    first, second = rows.filter("id % 2 = 0").withColumn("route", F.lit("first")), rows.filter("id % 2 = 1 or id % 3 = 0").withColumn("route", F.lit("second"))
    return roster.choose_route(first, second, n, n, ["id"]).select("id", "route")


@query("roster_violations", f"""WITH r AS (SELECT *, id % 50 AS g FROM ({CURR}) WHERE target = 'representatives')
SELECT 'row_count' AS rule, '' AS key, count(*) AS n FROM r HAVING count(*) NOT BETWEEN 1 AND 5 UNION ALL SELECT 'required_image', '', count(*) FROM r HAVING count(*) > 0 UNION ALL SELECT 'fixed_party', '', count(*) FROM r WHERE party <> 'P0' HAVING count(*) > 0 UNION ALL SELECT 'unique_g_party', concat(cast(g AS string), '|', party), count(*) FROM r GROUP BY g, party HAVING count(*) > 1""")
def roster_violations(s, d):
    rows = curr(s, d).filter("target = 'representatives'").withColumn("g", F.col("id") % 50)
    return quality.validate(rows, 1, 5, ["name", "image"], [["id"], ["g", "party"]], {"party": "P0"})


_ITEMS = """SELECT c_custkey AS ord, concat('{"id":', CASE c_custkey % 11 WHEN 0 THEN '"x"' WHEN 1 THEN '"12"' WHEN 2 THEN '{}' ELSE cast(c_custkey % 1000 AS string) END,
CASE WHEN c_custkey % 7 = 0 THEN ',"name":" "' WHEN c_custkey % 7 = 1 THEN '' ELSE concat(',"name":"', c_name, '"') END,
CASE c_custkey % 5 WHEN 0 THEN ',"group":3' WHEN 1 THEN ',"group":null' ELSE '' END,
CASE c_custkey % 3 WHEN 0 THEN ',"nextElectionYear":"soon"' WHEN 1 THEN ',"nextElectionYear":"2028"' ELSE '' END,
CASE c_custkey % 13 WHEN 0 THEN '' WHEN 1 THEN ',"images":"a.jpg"' WHEN 2 THEN ',"images":["a",1]' WHEN 3 THEN ',"images":[null]' WHEN 4 THEN ',"images":[]' ELSE ',"images":["a","b"]' END, '}') AS j FROM customer"""


@query("roster_shapes", f"""WITH i AS (SELECT ord, ord % 11 AS e, ord % 7 AS v, ord % 13 AS g FROM ({_ITEMS})), k AS (SELECT ord, CASE WHEN e IN (0, 2) THEN NULL WHEN e = 1 THEN 12 ELSE ord % 1000 END AS id FROM i)
SELECT ord, 'shape_id' AS rule FROM i WHERE e IN (0, 2) UNION ALL SELECT ord, 'shape_name' FROM i WHERE v IN (0, 1) UNION ALL SELECT ord, 'shape_group' FROM i WHERE ord % 5 = 0 UNION ALL SELECT ord, 'shape_nextElectionYear' FROM i WHERE ord % 3 = 0 UNION ALL SELECT ord, 'shape_images' FROM i WHERE g < 4
UNION ALL SELECT ord, 'repeated' FROM (SELECT ord, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM k WHERE id IS NOT NULL) WHERE n > 1""")
def roster_shapes(s, d):
    """Rows of a roster whose fields aren't what they must be, and which rule they break."""
    rows = derived(s, d, _ITEMS, "customer").select("ord", F.parse_json("j").alias("v")).withColumn("id", F.try_variant_get("v", "$.id", "double"))
    shape = {"id": "finite", "name": "name", "group": "text?", "nextElectionYear": "finite?", "images": "texts"}
    return quality.shape_violations(rows, shape, unique="id").select("ord", "rule")


@query("gated_merge", f"""WITH n AS (SELECT name, role AS sub_role, ord FROM ({CURR}) WHERE target = 'senators'), o AS (SELECT name, party AS sub_role, ord FROM ({PREV}) WHERE target = 'senators')
SELECT coalesce(n.name, o.name) AS name, coalesce(n.sub_role, o.sub_role) AS sub_role, CASE WHEN n.name IS NULL THEN 'seed' ELSE 'live' END AS source_mode FROM n FULL OUTER JOIN (SELECT name, arg_min(sub_role, ord) AS sub_role FROM o GROUP BY name) o ON n.name = o.name""")
def gated_merge(s, d):
    """Valid new rows, merged with the old ones."""
    shaped = lambda df, role: df.filter("target = 'senators'").select("name", F.col(role).alias("sub_role"), F.lit("衆議院").alias("chamber"), "ord")
    merge = lambda new, old: roster.merge_keep(new, old, ["name"])
    return quality.gated_publish(shaped(curr(s, d), "role"), shaped(prev(s, d), "party"), 5, merge).select("name", "sub_role", "source_mode")


@query("set_validity", f"SELECT false AS ok, concat('too-many-duplicates:', cast(count(*) - count(DISTINCT party) AS string)) AS reason FROM ({CURR}) WHERE target = 'senators'")
def set_validity(s, d):
    rows = curr(s, d).filter("target = 'senators'").select(F.col("party").alias("name"), F.col("role").alias("sub_role"), F.lit("衆議院").alias("chamber"))
    return quality.validate_set(rows, 10)


@query("gated_roster", f"SELECT target, id, name FROM ({CURR}) WHERE target = 'representatives'")
def gated_roster(s, d):
    """New rows without roles aren't valid: the old ones stay."""
    shaped = curr(s, d).select("target", "id", "name", F.col("role").alias("sub_role"), F.lit("衆議院").alias("chamber"))
    return quality.gated_publish(shaped.filter("target = 'senators'").withColumn("sub_role", F.lit("")), shaped.filter("target = 'representatives'"), 5).select("target", "id", "name")


# ---- linking -----------------------------------------------------------------------------------------------------
@query("filled_by_key", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN k IS NULL THEN '' ELSE concat('img', cast(k AS string)) END AS image, CASE WHEN c_custkey % 3 = 0 THEN 'already' WHEN k IS NULL THEN 'none' ELSE 'matched' END AS outcome FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def filled_by_key(s, d):
    rows = read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "own").otherwise("").alias("image"))
    pool = read(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.concat(F.lit("img"), F.col("o_orderkey").cast("string")).alias("image"))
    out = linking.fill_by_key(rows, pool, F.col("c_custkey").cast("string"), F.col("o_custkey").cast("string"))
    return out.withColumn("image", F.coalesce("image", F.lit("")))


@query("variant_matches", f"""WITH p AS (SELECT id, {_BARE} AS b FROM ({PEOPLE})), k AS (SELECT id, replace(replace(translate(b, '髙邊邉澤廣', '高辺辺沢広'), 'ー', ''), '君', '') AS key, translate(b, '髙邊邉澤廣', '高辺辺沢広') AS vk FROM p),
c AS (SELECT vk, count(*) AS n FROM k WHERE id % 3 = 0 GROUP BY vk)
SELECT k.id, CASE WHEN k.id % 5 = 0 THEN 'already' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, CASE WHEN k.id % 5 <> 0 AND n > 1 THEN n ELSE 0 END AS n_candidates FROM k LEFT JOIN c USING (vk)""")
def variant_matches(s, d):
    p = people(s, d)
    rows = p.select("id", "name", F.when(F.col("id") % 5 == 0, "own").otherwise("").alias("image"))
    pairs = p.filter("id % 3 = 0").select("name", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("image"), F.col("id").alias("ord"))
    return linking.match_variants(rows, pairs).select("id", "outcome", "n_candidates")


@query("match_outcomes", f"""WITH p AS (SELECT id, {_BARE} AS b FROM ({PEOPLE})), k AS (SELECT id, translate(b, '髙邊邉澤廣', '高辺辺沢広') AS vk FROM p), c AS (SELECT vk, count(*) AS n FROM k WHERE id % 3 = 0 GROUP BY vk)
SELECT CASE WHEN k.id % 5 = 0 THEN 'already' WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM k LEFT JOIN c USING (vk) GROUP BY 1""")
def match_outcomes(s, d):
    return linking.match_report(variant_matches(s, d))


@query("matched_by_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'P' || l_partkey WHEN l_suppkey % 3 = 0 THEN 'S' || l_suppkey END AS matched_key FROM lineitem")
def matched_by_keys(s, d):
    rows = read(s, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    p, q = read(s, d, "part").filter("p_partkey % 2 = 0"), read(s, d, "supplier").filter("s_suppkey % 3 = 0")
    pool = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.lit("a").alias("image"), F.col("p_partkey").alias("ord")).unionByName(q.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("b").alias("image"), F.col("s_suppkey").alias("ord")))
    keys = F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    return linking.match_by_keys(rows, pool, keys, "row").select("row.l_orderkey", "row.l_linenumber", "matched_key")


@query("resolved_people", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name' WHEN c_custkey % 3 = 1 AND n = 1 THEN 'kana' ELSE 'none' END AS resolved_by FROM customer LEFT JOIN (SELECT c_nationkey AS nk, cast(c_acctbal AS int) AS b, count(DISTINCT c_name) AS n FROM customer WHERE c_custkey % 3 < 2 GROUP BY ALL) ON nk = c_nationkey AND b = cast(c_acctbal AS int)")
def resolved_people(s, d):
    """By name, else by chamber and a reading that stands for the balance, rounded as SQL casts: halves to the even number."""
    c = read(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("chamber"), F.concat(F.lit("k"), F.rint("c_acctbal").cast("int").cast("string")).alias("kana"), F.col("c_custkey").alias("ord"))
    rows = c.withColumn("name", F.when(F.col("c_custkey") % 3 == 1, F.concat("name", F.lit("Z"))).otherwise(F.col("name"))).withColumn("kana", F.when(F.col("c_custkey") % 3 == 2, "").otherwise(F.col("kana")))
    persons = c.filter("c_custkey % 3 < 2").withColumn("image", F.when(F.col("c_custkey") % 3 == 0, "i").otherwise(""))
    return linking.resolve_person(rows, persons).select("c_custkey", "resolved_by")


@query("alias_matches", """WITH c AS (SELECT c_custkey AS entity_id, c_name, concat('n', c_nationkey, ' ', CAST(floor(c_acctbal / 10) AS BIGINT)) AS place FROM customer), e AS (SELECT entity_id, unnest([c_name, place]) AS alias FROM c),
m AS (SELECT o_orderkey AS mention_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN [c_name] WHEN 1 THEN [c_name, place] ELSE [place] END) AS alias FROM orders JOIN c ON entity_id = o_custkey), h AS (SELECT DISTINCT mention_id, entity_id FROM m JOIN e USING (alias))
SELECT mention_id, min(entity_id) AS entity_id FROM h GROUP BY mention_id HAVING count(*) = 1""")
def alias_matches(s, d):
    """Orders name their customer by name, by place, or by both; a place may be several customers'."""
    place = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(" "), F.floor(F.col("c_acctbal") / 10).cast("string"))
    entities = read(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name", place.alias("place"))
    named = read(s, d, "orders").join(entities, F.col("entity_id") == F.col("o_custkey")).select(F.col("o_orderkey").alias("mention_id"), "c_name", "place")
    third = F.col("mention_id") % 3
    return linking.match_aliases(named, entities, F.when(third == 0, F.array("c_name")).when(third == 1, F.array("c_name", "place")).otherwise(F.array("place")), F.array("c_name", "place"))


@query("contained_items", "WITH h AS (SELECT DISTINCT doc_id AS text_id, item_id AS entity_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '') SELECT text_id, min(entity_id) AS entity_id FROM h GROUP BY 1 HAVING count(*) = 1")
def contained_items(s, d):
    texts = read(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return linking.link_contained(texts, read(s, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.col("text").alias("key")))


@query("links_nearby", None)
def links_nearby(s, d):
    """The one page whose link text stands near a link; link texts of all links of all pages are the names."""
    pages = read(s, d, "pages")
    shown = F.regexp_extract_all("html", F.lit("<a href=\"[^\"]*\">([^<]{6,})</a>"), F.lit(1))
    names = pages.select("page_id", F.explode(shown).alias("key")).groupBy("key").agg(F.min("page_id").alias("entity_id"))
    return linking.link_near(pages, names, r"href=\"[^\"]*\"", 60)


@query("zipped_lists", "SELECT a.doc_id, b.n_chars FROM documents a JOIN documents b ON a.doc_id = b.doc_id WHERE a.doc_id % 2 = 0")
def zipped_lists(s, d):
    docs = read(s, d, "documents").withColumn("ord", F.col("doc_id"))
    return linking.zip_by_position(docs.filter("doc_id % 2 = 0").select("ord", "doc_id"), docs.select("ord", "n_chars")).select("doc_id", "n_chars")


@query("merged_candidates", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE p_brand END AS image, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN [p_type, p_name] ELSE [p_brand, p_type, p_name] END, ',') AS urls FROM part")
def merged_candidates(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "own").otherwise("").alias("image"), F.array("p_type", F.lit("")).alias("c"), F.array("p_name", "p_type").alias("pg"), F.col("p_brand").alias("direct"))
    return linking.merge_candidates(p, "c", "pg", "direct").select("p_partkey", "image", F.array_join("c", ",").alias("urls"))


@query("ranked_candidates", """WITH b AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS score, min(l_orderkey * 10 + l_linenumber) FILTER (true) AS x FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey, l_partkey, l_quantity, l_orderkey * 10 + l_linenumber AS ord FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, ord) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, ord, l_partkey) AS n FROM o)
SELECT l_suppkey, string_agg(l_partkey, ',' ORDER BY n) FILTER (n <= 5) AS candidates, count(*) AS n_urls, CASE WHEN count(*) = 1 THEN 'applied' ELSE 'review' END AS status FROM t GROUP BY l_suppkey""")
def ranked_candidates(s, d):
    cands = read(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return linking.rank_candidates(cands, "l_suppkey", "l_partkey", "l_quantity").select("l_suppkey", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"), "n_urls", "status")


_BY_SOURCE = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END"


@query("source_priority", f"""SELECT 'all' AS mode, o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_BY_SOURCE}, o_orderkey) = 1
UNION ALL SELECT 'fix', o_custkey, o_orderkey FROM orders WHERE o_orderkey % 5 <> o_custkey % 5 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_BY_SOURCE}, o_orderkey) = 1""")
def source_priority(s, d):
    """In fix mode a customer's present URL isn't taken again, however it is written."""
    orders = read(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("source"), F.concat(F.lit("https://A.example/x//"), (F.col("o_orderkey") % 5).cast("string"), F.lit("?q")).alias("url"), F.col("o_orderkey").alias("ord"))
    now = orders.select("o_custkey").distinct().withColumn("image", F.concat(F.lit("https://a.example/x/"), (F.col("o_custkey") % 5).cast("string")))
    sources = ("1-URGENT", "5-LOW")
    every = linking.resolve_by_priority(orders, "o_custkey", "source", sources).withColumn("mode", F.lit("all"))
    fixed = linking.resolve_by_priority(orders, "o_custkey", "source", sources, now).withColumn("mode", F.lit("fix"))
    return every.unionByName(fixed).select("mode", "o_custkey", "o_orderkey")


@query("restricted_rows", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def restricted_rows(s, d):
    return learning.restrict(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# ---- ranking -----------------------------------------------------------------------------------------------------
@query("first_of_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_of_key(s, d):
    return ranking.dedup_keep(read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("best_line", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def best_line(s, d):
    return ranking.best_per(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], F.col("l_extendedprice"), ["l_linenumber"])


@query("newest_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def newest_events(s, d):
    return ranking.keep_last(read(s, d, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@query("feed_history", "WITH l AS (SELECT user_id, CAST(floor(value / 4) AS BIGINT) AS generated_at, max(event_id) AS viewed_at FROM events GROUP BY ALL) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC) <= 20")
def feed_history(s, d):
    views = read(s, d, "events").select("user_id", F.floor(F.col("value") / 4).cast("long").alias("generated_at"), F.col("event_id").alias("viewed_at"))
    return ranking.feed_history(views, rules.FEED_HISTORY)


@query("balanced_cycle", "WITH g AS (SELECT c_mktsegment AS g, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS group_rank FROM customer GROUP BY 1) SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('s:', c_custkey)), c_custkey) AS turn, CAST(group_rank AS INT) AS group_rank FROM customer JOIN g ON g = c_mktsegment")
def balanced_cycle(s, d):
    return ranking.balanced_order(read(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment"), "s", "c_custkey").select("c_custkey", "turn", "group_rank")


@query("sampled", "SELECT p_partkey FROM part ORDER BY md5(concat('s:', p_partkey)), p_partkey LIMIT 50")
def sampled(s, d):
    return ranking.sample_n(read(s, d, "part").select("p_partkey"), 50, "s", "p_partkey")


@query("choices", """WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY md5(concat('c:', p_partkey)), p_partkey) AS spot, count(*) OVER () AS n FROM part), q AS (SELECT id, spot, n, unnest(range(0, least(3, n - 1) + 1)) AS step FROM r),
c AS (SELECT q.id, r.id AS choice FROM q JOIN r ON r.spot = (q.spot - 1 + step) % q.n + 1) SELECT id, string_agg(choice, ',' ORDER BY md5(concat('c:', id, ':', choice))) AS choices FROM c GROUP BY id""")
def choices(s, d):
    parts = read(s, d, "part").select(F.col("p_partkey").alias("id"))
    return ranking.make_choices(parts, parts, "c").select("id", F.array_join(F.transform("choices", lambda x: x.cast("string")), ",").alias("choices"))


_ORDERS = {"name_asc": "name, id", "name_desc": "name DESC, id", "district": "district, name, id", "terms_asc": "terms IS NULL, terms, name, id", "terms_desc": "terms IS NULL, terms DESC, name, id", "year_asc": "year IS NULL, year, name, id", "year_desc": "year IS NULL, year DESC, name, id"}


@query("roster_order", f"WITH r AS (SELECT *, CASE WHEN id % 4 > 0 THEN 2020 + id % 7 END AS year FROM ({CURR}) WHERE target = 'senators') " + " UNION ALL ".join(f"SELECT '{k}' AS sort, id, row_number() OVER (ORDER BY {o}) AS place FROM r" for k, o in _ORDERS.items()))
def roster_order(s, d):
    """The whole roster's places in each of its orders; names are sorted up and down once, other orders go by their places."""
    rows = curr(s, d).filter("target = 'senators'").select("id", "name", "kana", "district", "terms").withColumn("next_election_year", F.when(F.col("id") % 4 > 0, 2020 + F.col("id") % 7))
    named = ranking.ranked(rows, [], ranking.roster_order("name_asc"), "place")
    out, placed = named.select(F.lit("name_asc").alias("sort"), "id", "place"), named.withColumnRenamed("place", "_named")
    needed = {"name_desc": ("name", "kana"), "district": ("district",), "terms": ("terms",), "year": ("next_election_year",)}
    for key in [k for k in _ORDERS if k != "name_asc"]:
        lean = placed.select("id", "_named", *(needed.get(key) or needed[key.split("_")[0]]))
        one = ranking.ranked(lean, [], ranking.roster_order(key, "_named"), "place")
        out = out.unionByName(one.select(F.lit(key).alias("sort"), "id", "place"))
    return out


@query("review_order", f"""WITH a AS (SELECT name, CAST(CASE WHEN image = '' THEN 150 WHEN image LIKE '%wikimedia%' THEN 16 WHEN image LIKE '%sangiin%' THEN -10 WHEN image LIKE '%noimage%' THEN 50 ELSE 0 END AS INTEGER) AS image_score FROM ({ASSETS}))
SELECT name, image_score, row_number() OVER (ORDER BY image_score DESC, name) AS place FROM a""")
def review_order(s, d):
    rows = asset_rows(s, d).select("name", urls.score_asset(F.col("image")).alias("image_score"))
    return ranking.ranked(rows, [], ranking.review_order(), "place")


# ---- assets ------------------------------------------------------------------------------------------------------
_SCORE = "(CASE WHEN image = '' THEN 150 WHEN image LIKE '%wikimedia%' THEN 16 WHEN image LIKE '%go.jp%' THEN -10 WHEN image LIKE '%noimage%' THEN 50 ELSE 0 END)"


@query("asset_quality", f"SELECT count(*) AS total, count(*) FILTER (c = 'ok') AS ok, count(*) FILTER (c = 'review') AS review, count(*) FILTER (c = 'missing') AS missing FROM (SELECT CASE WHEN image = '' THEN 'missing' WHEN image_status = 'review' OR {_SCORE} >= 10 THEN 'review' ELSE 'ok' END AS c FROM ({ASSETS}))")
def asset_quality(s, d):
    return assets.quality_summary(asset_rows(s, d))


@query("asset_scores", f"SELECT ord, {_SCORE} AS score, image = '' OR image LIKE '%noimage%' AS bad, CASE WHEN image LIKE '%poster%' THEN 'poster' ELSE '' END AS blocked FROM ({ASSETS})")
def asset_scores(s, d):
    return asset_rows(s, d).select("ord", urls.score_asset(F.col("image")).alias("score"), urls.is_bad_asset(F.col("image")).alias("bad"), urls.block_reason(F.col("image")).alias("blocked"))


@query("rejected_source", f"SELECT ord, CASE WHEN image LIKE '%wikimedia%' OR image_source = 'wikipedia' THEN '' ELSE image END AS image, CASE WHEN image LIKE '%wikimedia%' OR image_source = 'wikipedia' THEN CASE WHEN ord % 2 = 0 THEN 'review' ELSE 'missing' END ELSE image_status END AS image_status FROM ({ASSETS})")
def rejected_source(s, d):
    rows = asset_rows(s, d).withColumn("image_candidates", F.when(F.col("ord") % 2 == 0, F.array(F.lit("https://a.example/1.jpg"), F.lit("https://wikipedia.org/x"))).otherwise(F.array(F.lit("https://wikimedia.org/2"))))
    return assets.reject_source(rows, "wikipedia|wikimedia").select("ord", "image", "image_status")


@query("rejection_counts", f"SELECT count(*) FILTER (image LIKE '%wikimedia%' OR image_source = 'wikipedia') AS cleared, CAST(count(*) AS BIGINT) AS removed, count(*) AS changed FROM ({ASSETS})")
def rejection_counts(s, d):
    rows = asset_rows(s, d).withColumn("image_candidates", F.array(F.lit("https://wikimedia.org/2")))
    return assets.rejection_counts(assets.reject_source(rows, "wikipedia|wikimedia"))


@query("work_queue", f"""WITH a AS (SELECT * FROM ({ASSETS})) SELECT * FROM (SELECT 'all' AS mode, ord FROM a ORDER BY ord LIMIT 25) UNION ALL SELECT * FROM (SELECT 'review', ord FROM a WHERE image <> '' AND ai_guess ORDER BY ord LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'fix', ord FROM a WHERE ord % 8 = 3 ORDER BY ord LIMIT 25) UNION ALL SELECT * FROM (SELECT 'missing', ord FROM a WHERE image = '' AND ord % 2 = 0 ORDER BY ord LIMIT 25)""")
def work_queue(s, d):
    """The first rows of each mode's queue."""
    rows, out = asset_rows(s, d), None
    for mode in ("all", "review", "fix", "missing"):
        one = assets.work_queue(rows, mode, rows.filter("ord % 8 = 3"), F.col("ord") % 2 == 0).select(F.lit(mode).alias("mode"), "ord")
        out = one if out is None else out.unionByName(one)
    return out


@query("asset_flags", f"SELECT ord, image_source NOT IN ('wikipedia', 'official-profile', 'trusted-fallback') AS ai_guess, image_source IN ('web-fallback', 'trusted-fallback') AS mask_bottom FROM ({ASSETS})")
def asset_flags(s, d):
    return assets.asset_flags(asset_rows(s, d)).select("ord", "ai_guess", "mask_bottom")


@query("review_reasons", f"""SELECT ord, r AS reason FROM (SELECT ord, CASE WHEN image = '' THEN 'no_image' WHEN image LIKE '%poster%' THEN 'poster_image' WHEN image_source_url LIKE '%youtube%' THEN 'sns_or_video_thumbnail' WHEN ai_guess THEN 'estimated_candidate' WHEN image_source = 'trusted-fallback' THEN 'trusted_fallback_review' WHEN image_source = 'web-fallback' THEN 'needs_manual_check' ELSE 'manual_review' END AS r FROM ({ASSETS})) WHERE r <> 'manual_review'""")
def review_reasons(s, d):
    return assets.review_list(asset_rows(s, d)).select("ord", "reason")


@query("review_csv", f"""SELECT name, party, CASE WHEN image = '' THEN 'missing' ELSE 'review' END AS status, concat(party, ' | ', role, ' "x"') AS hints FROM ({ASSETS})""")
def review_csv(s, d):
    """What the written file holds, read back by Spark's own reader."""
    rows = asset_rows(s, d).select("name", "party", F.when(assets.has_asset(), "review").otherwise("missing").alias("status"), F.array("party", F.concat("role", F.lit(' "x"'))).alias("hints"))
    path, columns = new_path(s, "review-csv"), ("name", "party", "status", "hints")
    files.write_review_csv(rows, path, columns)
    return s.read.options(header=True, escape='"').schema(", ".join(f"{c} string" for c in columns)).csv(path)


@query("source_mix", f"SELECT CASE WHEN image = '' THEN 'empty' WHEN image_source = 'official-profile' THEN 'official' WHEN image_source = 'wikipedia' THEN 'wikipedia' ELSE 'web' END AS kind, count(*) AS n FROM ({ASSETS}) GROUP BY 1")
def source_mix(s, d):
    return assets.source_counts(asset_rows(s, d))


@query("still_missing", f"SELECT ord FROM ({ASSETS}) WHERE image = ''")
def still_missing(s, d):
    return assets.remaining(asset_rows(s, d)).select("ord")


@query("search_worklist", f"SELECT row_number() OVER (ORDER BY ord) AS index, name, concat(name, ' 衆議院 顔') AS query, concat(name, ' プロフィール') AS query_alt1, concat(name, ' 公式') AS query_alt2 FROM ({ASSETS}) WHERE image = ''")
def search_worklist(s, d):
    return assets.search_worklist(assets.remaining(asset_rows(s, d)))


@query("page_relevance", "SELECT page_id, CAST(r AS INT) AS relevance FROM (SELECT page_id, (CASE WHEN html LIKE '%The%' THEN 4 ELSE 0 END) + (CASE WHEN html LIKE '%und%' THEN 1 ELSE 0 END) + (CASE WHEN html LIKE '%que%' THEN 1 ELSE 0 END) AS r FROM pages) WHERE r >= 4")
def page_relevance(s, d):
    return assets.relevant_pages(read(s, d, "pages"), F.col("html"), F.lit("The"), ("und", "que")).select("page_id", "relevance")


@query("source_states", "WITH l AS (SELECT user_id, event_type, arg_max(value > 20, (ts, event_id)) AS bad FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) SELECT user_id AS entity, count(*) FILTER (bad) < 2 AS sources_remain FROM l GROUP BY 1")
def source_states(s, d):
    e = read(s, d, "events").filter("event_type in ('view', 'click')")
    log = e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.when(F.col("value") > 20, "not_found").otherwise("ok").alias("state"), F.struct("ts", "event_id").alias("at"))
    return assets.source_state(log, log, ("view", "click"))


# ---- markup ------------------------------------------------------------------------------------------------------
@query("page_links", """SELECT page_id, i - 1 AS ord, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs, unnest(range(1, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) + 1)) AS i FROM pages)""")
def page_links(s, d):
    return markup.extract_links(read(s, d, "pages")).select("page_id", F.col("ord").cast("long").alias("ord"), "href")


@query("page_scan", """SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n_candidates FROM pages""")
def page_scan(s, d):
    pages = read(s, d, "pages")
    return assets.scan_report(pages, markup.extract_links(pages))


@query("scan_totals", f"""WITH p AS (SELECT page_id % 5 = 0 AS failed, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS n FROM pages), t AS (SELECT count(*) AS pages, count(*) FILTER (NOT failed) AS scanned, CAST(sum(n) FILTER (NOT failed) AS BIGINT) AS candidates FROM p)
SELECT t.*, a.* FROM t, (SELECT count(*) FILTER (ord % 3 = 0) AS applied, count(*) FILTER (ord % 3 = 1) AS review, count(*) FILTER (ord % 3 = 2) AS missing FROM ({ASSETS})) a""")
def scan_totals(s, d):
    pages = read(s, d, "pages")
    report = assets.scan_report(pages, markup.extract_links(pages)).withColumn("failed", F.col("page_id") % 5 == 0)
    rows = asset_rows(s, d).withColumn("image_status", F.element_at(F.array(F.lit("ok"), F.lit("review"), F.lit("missing")), (F.col("ord") % 3 + 1).cast("int")))
    return assets.scan_totals(report, rows, failed="failed")


@query("page_blocks", """SELECT page_id, regexp_extract(b, '">([^<]*)', 1) AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>.*?</li>')) AS b FROM pages) WHERE regexp_extract(b, '">([^<]*)', 1) <> ''""")
def page_blocks(s, d):
    return markup.extract_blocks(read(s, d, "pages"), r"(?s)<li>.*?</li>", {"label": r'">([^<]*)'}, ("label",)).select("page_id", "label")


@query("walked_json", "SELECT event_id AS doc_id, 0 AS ord, event_type AS text, NULL::VARCHAR AS image FROM events UNION ALL SELECT event_id, 1, concat('https://i.example/', event_id, '.jpg'), concat('https://i.example/', event_id, '.jpg') FROM events")
def walked_json(s, d):
    e = read(s, d, "events")
    doc = F.to_json(F.struct("event_type", F.array(F.struct(F.concat(F.lit("https://i.example/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("src"), F.lit(3).alias("width"))).alias("photos")))
    return markup.walk_json(e.select(F.col("event_id").alias("doc_id"), doc.alias("json"))).select("doc_id", "ord", "text", "image")


@query("role_lines", "SELECT doc_id AS page_id, regexp_extract(line, '^(.+?(?:tion|ung))\\s+(.+)$', 1) AS role FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM documents) WHERE regexp_matches(line, '^(.+?(?:tion|ung))\\s+(.+)$')")
def role_lines(s, d):
    lines = markup.text_lines(read(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))
    return markup.parse_role_lines(lines, r"^(.+?(?:tion|ung))\s+(.+)$").select("page_id", "role")


@query("line_records", """WITH l AS (SELECT doc_id AS page_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents), t AS (SELECT page_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM l), k AS (SELECT *, ends_with(line, 'he.') OR ends_with(line, 'en.') AS is_name FROM t WHERE line <> ''),
r AS (SELECT *, coalesce(sum(CASE WHEN is_name THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record FROM k)
SELECT page_id, CAST(record AS BIGINT) AS record, arg_min(line, pos) FILTER (is_name) AS name, count(DISTINCT regexp_replace(line, '^・\\s*', '')) FILTER (NOT is_name) AS n_roles FROM r GROUP BY page_id, record HAVING count(*) FILTER (is_name) > 0""")
def line_records(s, d):
    pages = read(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return markup.page_records(pages, lambda x: x.endswith("he.") | x.endswith("en.")).select("page_id", "record", "name", F.size("roles").cast("long").alias("n_roles"))


@query("parse_scores", f"SELECT party AS tag, count(*) AS n, CAST(count(*) * 10 + count(DISTINCT nullif(role, '')) * 2 - (count(*) - count(DISTINCT name)) * 15 + count(*) * 3 + 2 * count(*) + 4 * count(*) FILTER (role LIKE '%role 1%') AS BIGINT) AS score FROM ({CURR}) WHERE target = 'senators' GROUP BY 1")
def parse_scores(s, d):
    rows = curr(s, d).filter("target = 'senators'").select(F.col("party").alias("tag"), "name", "kana", F.col("role").alias("sub_role"), F.lit("衆議院").alias("chamber"))
    return markup.score_entry_sets(rows, ["role 1"])


@query("best_parse", f"WITH g AS (SELECT party, count(*) AS n, count(*) * 10 + count(DISTINCT nullif(role, '')) * 2 - (count(*) - count(DISTINCT name)) * 15 + count(*) * 3 + 2 * count(*) + 4 * count(*) FILTER (role LIKE '%role 1%') AS s FROM ({CURR}) WHERE target = 'senators' GROUP BY 1), b AS (SELECT party FROM g ORDER BY s DESC, n DESC, party LIMIT 1) SELECT id FROM ({CURR}) WHERE target = 'senators' AND party IN (SELECT party FROM b)")
def best_parse(s, d):
    rows = curr(s, d).filter("target = 'senators'").select("id", F.col("party").alias("tag"), "name", "kana", F.col("role").alias("sub_role"), F.lit("衆議院").alias("chamber"))
    return markup.best_set(rows, markup.score_entry_sets(rows, ["role 1"])).select("id")


# ---- learning ----------------------------------------------------------------------------------------------------
_ST = """CASE e.grade WHEN 'again' THEN least(greatest(s.stability * 0.45, 0.15), 3650)
 WHEN 'strong' THEN least(greatest(CASE WHEN s.reps = 0 THEN 1.25 ELSE greatest(s.stability, 0.15) * (2.05 + (11 - s.difficulty) / 10 * 0.95) * (1 + (1 - exp(-greatest((e."at" - s.seen) / 86400000.0, 0) / greatest(s.stability, 0.15))) * 0.35) * (1 + least(s.streak + 1, 8) * 0.08 + 0.12) END, 0.8), 3650)
 WHEN 'hard' THEN least(greatest(greatest(s.stability, 0.15) * (CASE WHEN s.reps = 0 THEN 1.4 ELSE 1.18 + (11 - s.difficulty) / 10 * 0.22 END) * (1 + (1 - exp(-greatest((e."at" - s.seen) / 86400000.0, 0) / greatest(s.stability, 0.15))) * 0.35), 0.25), 3650)
 ELSE least(greatest(CASE WHEN s.reps = 0 THEN 0.75 ELSE greatest(s.stability, 0.15) * (1.65 + (11 - s.difficulty) / 10 * 0.75) * (1 + (1 - exp(-greatest((e."at" - s.seen) / 86400000.0, 0) / greatest(s.stability, 0.15))) * 0.35) * (1 + least(s.streak + 1, 8) * 0.08) END, 0.4), 3650) END"""
_FOLD = f"""WITH RECURSIVE g AS ({GRADES_DUCK}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, mode, target, id ORDER BY "at", seq) AS k FROM g),
f AS (SELECT n.*, CAST(0 AS BIGINT) AS reps, CAST(0.3 AS DOUBLE) AS stability, CAST(5 AS DOUBLE) AS difficulty, CAST(0 AS BIGINT) AS lapses, CAST(0 AS BIGINT) AS streak, "at" AS seen, CAST('' AS VARCHAR) AS status, CAST('' AS VARCHAR) AS was, CAST(0 AS BIGINT) AS minutes, CAST(0 AS BIGINT) AS done FROM n WHERE k = 1
 UNION ALL
 SELECT e.user_id, e.mode, e.target, e.id, e.seq, e."at", e.grade, e.k, e.reps2, e.st, e.diff2, e.lapses2, e.streak2, e."at", CASE WHEN e.grade = 'again' THEN CASE WHEN e.lapses2 >= 3 THEN 'leech' ELSE 'learning' END WHEN (e.grade = 'strong' AND e.streak2 >= 5 AND e.st >= 35 AND e.lapses0 <= 1) OR (e.grade = 'good' AND e.streak2 >= 6 AND e.st >= 45 AND e.lapses0 <= 1) THEN 'mastered' WHEN e.st >= 7 THEN 'review' ELSE 'learning' END, e.status0,
  CASE WHEN e.grade = 'again' THEN CASE e.lapses2 WHEN 1 THEN 10 WHEN 2 THEN 30 ELSE 240 END WHEN e.grade = 'strong' THEN greatest(1440, CAST(floor(e.st * 1440 + 0.5) AS BIGINT)) WHEN e.grade = 'hard' THEN greatest(60, CAST(floor(e.st * 864 + 0.5) AS BIGINT)) ELSE greatest(720, CAST(floor(e.st * 1440 + 0.5) AS BIGINT)) END, e.k
 FROM (SELECT e.*, s.status AS status0, s.lapses AS lapses0, CASE WHEN e.grade = 'again' THEN 0 ELSE least(s.reps + 1, 100) END AS reps2, {_ST} AS st, least(greatest(s.difficulty + CASE e.grade WHEN 'again' THEN 0.7 WHEN 'strong' THEN -0.18 WHEN 'hard' THEN 0.15 ELSE -0.1 END, 1), 10) AS diff2, s.lapses + CASE WHEN e.grade = 'again' THEN 1 ELSE 0 END AS lapses2, CASE WHEN e.grade = 'again' THEN 0 ELSE s.streak + 1 END AS streak2
  FROM f s JOIN n e ON e.user_id = s.user_id AND e.id = s.id AND e.k = s.done + 1) e),
t AS (SELECT *, "at" + minutes * 60000 AS due FROM f WHERE done > 0), z AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY done DESC) = 1),
risk AS (SELECT *, exp(-greatest(({NOW} - seen) / 86400000.0, 0) / greatest(stability, 0.15)) AS recall FROM z),
scored AS (SELECT *, 1 - recall + CASE WHEN due <= {NOW} THEN 0.5 + least(({NOW} - due) / 86400000.0, 6) * 0.18 ELSE 0 END + CASE WHEN status = 'leech' THEN 0.45 ELSE 0 END + least(lapses * 0.08, 0.4) AS score, status = 'mastered' AND due > {NOW} AS mastered FROM risk)
"""


def _now():
    return F.lit(NOW).cast("long")


def _learners(s, d):
    return grades(s, d).select("id", "target").distinct()


def _states(s, d):
    return learning.replay(grades(s, d))


@query("memory_states", _FOLD + "SELECT user_id, id, reps, minutes, due, round(stability, 6) AS stability, round(difficulty, 6) AS difficulty, lapses, streak, status, seen FROM z")
def memory_states(s, d):
    st = F.col("state")
    return _states(s, d).select("user_id", "id", st["reps"].cast("long").alias("reps"), st["interval_min"].alias("minutes"), st["due"].alias("due"), F.round(st["stability"], 6).alias("stability"), F.round(st["difficulty"], 6).alias("difficulty"), st["lapses"].cast("long").alias("lapses"), st["consecutive"].cast("long").alias("streak"), st["status"].alias("status"), st["last_seen_at"].alias("seen"))


@query("forgetting_scores", _FOLD + "SELECT user_id, id, round(recall, 6) AS recall, round(score, 6) AS score, mastered FROM scored")
def forgetting_scores(s, d):
    st = F.col("state")
    return _states(s, d).select("user_id", "id", F.round(memory.recall(st, _now()), 6).alias("recall"), F.round(memory.forgetting_score(st, _now()), 6).alias("score"), memory.is_mastered(st, _now()).alias("mastered"))


@query("lifetime_stats", _FOLD + "SELECT user_id, count(*) AS played, count(*) FILTER (grade <> 'again') AS correct, count(*) FILTER (grade = 'again') AS wrong, count(*) FILTER (status = 'mastered' AND was <> 'mastered') AS mastered, count(*) FILTER (status = 'leech' AND was <> 'leech') AS leech FROM t GROUP BY user_id")
def lifetime_stats(s, d):
    return learning.lifetime_stats(grades(s, d))


@query("graded_steps", _FOLD + "SELECT user_id, id, seq, grade, CASE WHEN done = 1 THEN NULL ELSE was END AS status_before, status, reps, lapses, minutes, round(stability, 6) AS stability FROM t")
def graded_steps(s, d):
    """Every graded answer with the item's status before it and the state after it."""
    a = F.col("after")
    return learning.trail(grades(s, d)).select("user_id", "id", "seq", "grade", F.col("before.status").alias("status_before"), a["status"].alias("status"), a["reps"].cast("long").alias("reps"), a["lapses"].cast("long").alias("lapses"), a["interval_min"].alias("minutes"), F.round(a["stability"], 6).alias("stability"))


@query("item_sets", _FOLD + "SELECT user_id, id, arg_max(status = 'mastered', done) AS in_mastered, coalesce(arg_max(grade = 'again' OR status = 'leech', done) FILTER (grade = 'again' OR status = 'leech' OR (grade = 'good' AND streak >= 2)), false) AS in_wrong FROM t GROUP BY user_id, id")
def item_sets(s, d):
    return learning.mastered_wrong_sets(grades(s, d)).select("user_id", "id", "in_mastered", "in_wrong")


@query("progress_summary", _FOLD + f""", k AS (SELECT *, CASE WHEN mastered THEN 'r' WHEN status = 'leech' THEN 'l' WHEN grade = 'again' OR recall < 0.35 OR lapses >= 2 THEN 'n' ELSE 'h' END AS kind FROM scored), p AS (SELECT count(DISTINCT id) AS total FROM g)
SELECT user_id, total, count(*) FILTER (kind = 'r') AS remembered, count(*) FILTER (kind = 'h') AS hazy, count(*) FILTER (kind IN ('n', 'l')) AS not_remembered, total - count(*) AS not_checked, count(*) FILTER (kind IN ('n', 'h') AND (due - {NOW} <= 604800000 OR recall <= 0.55)) AS due_soon, count(*) FILTER (kind = 'l') AS leech FROM k, p GROUP BY user_id, total""")
def progress_summary(s, d):
    return learning.progress_summary(_learners(s, d), _states(s, d), _now()).drop("mode", "target")


@query("focus_summary", _FOLD + f"SELECT user_id, count(*) FILTER (NOT mastered AND (due <= {NOW} OR score >= 0.55)) AS due, count(*) FILTER (NOT mastered AND status = 'leech') AS leech, count(*) FILTER (mastered) AS mastered FROM scored GROUP BY user_id")
def focus_summary(s, d):
    return learning.focus_summary(_learners(s, d), _states(s, d), _now()).drop("mode", "target")


@query("risk_order", _FOLD + "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS risk_rank FROM scored")
def risk_order(s, d):
    return learning.order_by_risk(_states(s, d), _now()).select("user_id", "id", "risk_rank")


@query("session_results", f"SELECT user_id, count(*) AS total, count(*) FILTER (grade = 'good') AS remembered, count(*) FILTER (grade = 'hard') AS hazy, count(*) FILTER (grade = 'again') AS not_remembered, coalesce(string_agg(DISTINCT id, ',' ORDER BY id) FILTER (grade IN ('hard', 'again')), '') AS wrong_ids FROM ({GRADES_DUCK}) GROUP BY user_id")
def session_results(s, d):
    return learning.session_result(grades(s, d), ("user_id",)).withColumn("wrong_ids", F.array_join(F.transform("wrong_ids", lambda x: x.cast("string")), ","))


@query("miss_memory", f'''SELECT user_id, id, count(*) AS miss_count, max("at") AS last_miss_at FROM ({GRADES_DUCK}) WHERE grade IN ('hard', 'again') GROUP BY user_id, id''')
def miss_memory(s, d):
    return learning.miss_memory(grades(s, d)).select("user_id", "id", "miss_count", "last_miss_at")


@query("sanitized_states", "SELECT event_id, CAST(greatest(floor(value), 0) AS INT) AS reps, least(greatest(value, 1), 10) AS difficulty, CASE WHEN floor(value) <= 0 THEN 'new' WHEN value >= 4 THEN 'review' ELSE 'learning' END AS status FROM events")
def sanitized_states(s, d):
    none = F.lit(None).cast("string")
    raw = F.struct(F.col("value").cast("string").alias("reps"), none.alias("interval_min"), none.alias("due"), none.alias("last_grade"), none.alias("updated_at"), none.alias("stability"), F.col("value").cast("string").alias("difficulty"), none.alias("lapses"), none.alias("consecutive"), F.lit("odd").alias("status"), none.alias("last_seen_at"))
    st = memory.sanitize_state(raw, _now())
    return read(s, d, "events").select("event_id", st["reps"].alias("reps"), st["difficulty"].alias("difficulty"), st["status"].alias("status"))


@query("next_items", None)
def next_items(s, d):
    g = grades(s, d)
    asked = g.filter("seq % 7 = 0").select("user_id", "id")
    return learning.next_items(_learners(s, d), _states(s, d), asked, g.filter("id % 10 = 0").select("id"), _now())


@query("cycle_positions", f"""WITH g AS ({GRADES_DUCK}), u AS (SELECT DISTINCT user_id FROM g), i AS (SELECT DISTINCT id FROM g WHERE id % 4 <> 3),
o AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY (id * 37 + user_id * 11) % 101, id) - 1 AS pos, user_id % 150 - 20 AS cur FROM u, (SELECT DISTINCT id FROM g)),
l AS (SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1 AS spot, count(*) OVER (PARTITION BY user_id) AS size FROM o JOIN i USING (id)),
c AS (SELECT *, least(greatest(cur, 0), size) AS cursor FROM l),
f AS (SELECT user_id, arg_min(id, spot) AS id FROM c WHERE spot >= cursor AND NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = c.user_id AND g.id = c.id AND g.seq % 2 = 0) GROUP BY user_id)
SELECT user_id, f.id, CAST(cursor AS INTEGER) AS cursor, CAST(CASE WHEN f.id IS NULL THEN cursor ELSE least(cursor + 1, size) END AS INTEGER) AS next_cursor FROM (SELECT DISTINCT user_id, cursor, size FROM c) LEFT JOIN f USING (user_id)""")
def cycle_positions(s, d):
    """Each learner's place in a shuffled order of all items, of which a quarter has left the roster since."""
    g = grades(s, d)
    items = g.select("id").distinct()
    listed = items.agg(F.collect_set("id").alias("ids"))
    users = g.select("user_id").distinct().crossJoin(F.broadcast(listed))  # one row
    by = F.array_sort(F.transform("ids", lambda i: F.struct(((i * 37 + F.col("user_id") * 11) % 101).alias("at"), i.alias("id"))))
    cycles = users.select("user_id", (F.col("user_id") % 150 - 20).cast("int").alias("cursor"), F.transform(by, lambda x: x["id"]).alias("order"))
    return learning.next_in_cycle(cycles, g.filter("seq % 2 = 0").select("user_id", "id"), items.filter("id % 4 <> 3"))


@query("state_backup", "SELECT user_id, concat('app:', event_type) AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY ALL")
def state_backup(s, d):
    """Each user's store as one JSON object, and back."""
    last = read(s, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").cast("string").alias("value"))
    kv = last.select("user_id", F.explode(F.array(F.concat(F.lit("app:"), "event_type"), F.concat(F.lit("other:"), "event_type"))).alias("key"), "value")
    return files.import_state(files.export_state(kv, "app:"), "app:")


# ---- files and pages that Spark derives from the tables ----------------------------------------------------------
#: People of a derived file: files multiply with the table, none grows with it.
FILE_ROWS = 1000


def _block(key: str):
    """Which of a nation's files a row goes to: keys of all 25 nations follow each other, so a file gets about ``FILE_ROWS``."""
    return F.floor(F.col(key) / (25 * FILE_ROWS)).alias("block")


def _json_lines(s, d):
    """A JSON array for each thousand customers of a nation, with a null element and a nameless one."""
    item = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("group"), F.array(F.lit(" "), F.concat(F.lit("i"), F.col("c_custkey").cast("string"))).alias("images")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("j")))), lambda x: x["j"])
    return read(s, d, "customer").groupBy("c_nationkey", _block("c_custkey")).agg(F.concat(F.lit('[null,{"name":" "},'), F.array_join(listed, ","), F.lit("]")).alias("value"))


def _roster_files(s, d):
    path = new_path(s, "rosters")
    _json_lines(s, d).repartition("c_nationkey", "block").write.partitionBy("c_nationkey", "block").text(path)
    return files.read_roster(s, f"{path}/*/*/*.txt", "senators", range_bytes=1 << 14)


@query("roster_files", "SELECT c_name AS name, CASE WHEN c_custkey > 0 THEN c_custkey ELSE 3 END AS id, c_mktsegment AS party, concat('i', c_custkey) AS image FROM customer")
def roster_files(s, d):
    return roster.normalize_person(_roster_files(s, d)).select("name", "id", "party", F.col("images")[0].alias("image"))


@query("differ_rows", "SELECT c_name AS name, concat('i', c_custkey) AS image, c_mktsegment AS role, '' AS party FROM customer")
def differ_rows(s, d):
    return roster.normalize_person(_roster_files(s, d), "diff").select("name", "image", "role", "party")


@query("asset_pool", "SELECT concat('P', p_partkey) AS id, concat('https://a.example/p', p_partkey, '_0.jpg') AS image FROM part")
def asset_pool(s, d):
    path = new_path(s, "pool")
    parts = read(s, d, "part").select(F.explode(F.array(F.concat(F.lit(" https://a.example/p"), F.col("p_partkey").cast("string"), F.lit("_0.jpg ")), F.concat(F.lit("https://a.example/p"), F.col("p_partkey").cast("string"), F.lit("_0.jpg")), F.lit(" "))).alias("value"))
    parts.write.text(path)
    return files.read_asset_pool(s, path)


@query("keyed_sources", "SELECT s_name AS key, CAST(s_nationkey AS BIGINT) AS n FROM supplier WHERE s_suppkey % 5 <> 0")
def keyed_sources(s, d):
    path = new_path(s, "keyed")
    pair = F.concat(F.lit('"'), F.when(F.col("s_suppkey") % 5 == 0, "_").otherwise(""), "s_name", F.lit('": {"n": '), F.col("s_nationkey").cast("string"), F.lit("}"))
    blocks = read(s, d, "supplier").groupBy("s_nationkey", _block("s_suppkey"))
    blocks.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ", "), F.lit("}")).alias("value")).repartition("s_nationkey", "block").write.partitionBy("s_nationkey", "block").text(path)
    return files.read_keyed_json(s, f"{path}/*/*/*.txt", "struct<n:long>", range_bytes=256).select("key", "value.n")


@query("published_snapshot", f"""SELECT ord, name, party, image, image_status, CASE WHEN image = '' THEN 'missing' ELSE 'with_image' END AS counted, 'previous' AS which FROM ({ASSETS})
UNION ALL SELECT ord, name, 'later', image, image_status, CASE WHEN image = '' THEN 'missing' ELSE 'with_image' END, 'current' FROM ({ASSETS}) WHERE ord % 3 <> 0""")
def published_snapshot(s, d):
    """Rows of the current and the previous snapshot after two were published and a third has failed on the way."""
    path, rows = new_path(s, "snapshots"), asset_rows(s, d)
    later = rows.filter("ord % 3 <> 0").withColumn("party", F.lit("later"))
    said = {}
    for name, df in (("previous", rows), ("current", later)):
        said[name] = files.publish_snapshot(df, path, name).first()
    try:
        files.publish_snapshot(rows.withColumn("name", F.when(F.col("ord") >= 0, F.raise_error(F.lit("broken"))).otherwise("")), path, "broken")
    except Exception as e:
        if "broken" not in str(e):
            raise
    counted, out = F.when(F.trim("image") == "", "missing").otherwise("with_image"), None
    for which, counts in said.items():
        back = files.read_snapshot(s, path, rows.schema, which)
        held = {r["counted"]: r["count"] for r in back.groupBy(counted.alias("counted")).count().collect()}
        if tuple(counts) != (sum(held.values()), held.get("with_image", 0), held.get("missing", 0)):
            raise ValueError(f"the snapshot's counts {counts} aren't those of its rows {held}")
        one = back.select("ord", "name", "party", "image", "image_status", counted.alias("counted"), F.lit(which).alias("which"))
        out = one if out is None else out.unionByName(one)
    return out


_PAGES = """SELECT s_suppkey AS page_id, concat('https://s.example/', cast(s_nationkey AS string), '/') AS url, concat('<table><tr><th>name</th><th>n</th></tr><tr><td>', s_name, '<table><tr><td>x</td></tr></table></td><td>', cast(s_nationkey AS string), '</td></tr><tr><td>short</td></tr></table><img class="i" src="', CASE WHEN s_suppkey % 3 = 0 THEN 'noimage.png' ELSE concat('p', cast(s_suppkey AS string), '.jpg') END, '" srcset="a.jpg 1x, b', cast(s_suppkey AS string), '.jpg 2x" alt="', s_name, '">') AS html FROM supplier"""


def _pages(s, d):
    return derived(s, d, _PAGES, "supplier")


@query("page_images", "SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 3 = 0 THEN 'noimage.png' ELSE concat('p', s_suppkey, '.jpg') END AS src, concat('https://s.example/', s_nationkey, '/', CASE WHEN s_suppkey % 3 = 0 THEN 'noimage.png' ELSE concat('p', s_suppkey, '.jpg') END) AS picked, concat('b', s_suppkey, '.jpg') AS largest FROM supplier")
def page_images(s, d):
    images = markup.extract_images(_pages(s, d)).join(_pages(s, d).select("page_id", "url"), "page_id")
    return images.select("page_id", "src", urls.pick_src(F.col("src"), F.col("data_src"), sets=[F.col("srcset")], base=F.col("url")).alias("picked"), urls.srcset_last(F.col("srcset")).alias("largest"))


@query("page_tables", "SELECT s_suppkey AS page_id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS n FROM supplier")
def page_tables(s, d):
    return markup.extract_table(_pages(s, d), ["name", "n"]).select("page_id", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("n"))


#: Pages with images in meta tags, lazy, bare and quoted attributes, comments and figures.
_SHOWN = """SELECT s_suppkey AS page_id, concat('https://s.example/', CASE WHEN s_suppkey % 2 = 0 THEN 'member' ELSE 'news' END, '/', cast(s_nationkey AS string), '.html') AS url, concat(
CASE WHEN s_suppkey % 5 = 0 THEN '<meta content="/og.jpg" property="og:image">' ELSE '' END, '<!-- <img src="/hidden.jpg"> --><div class=card><p>', s_name, ' b > a</p><img class=face src=p', cast(s_suppkey AS string), '.jpg alt="', s_name, ' d''Arc > x"><img src="/og.jpg" alt=again></div>',
CASE WHEN s_suppkey % 3 = 0 THEN '<figure><img data-lazy-src=''photo/l.png'' title="group" src="logo.png"></figure>' ELSE '<img alt=''a "b" c'' data-src="../profile/f.webp" src="data:image/gif;base64,R0" srcset="s1.jpg 1x, s2.jpg 2x">' END) AS html FROM supplier"""


@query("page_candidates", f"""WITH p AS (SELECT page_id, s_suppkey, s_name, s_nationkey, url AS page, s_suppkey % 2 = 0 AS m FROM ({_SHOWN}) x JOIN supplier ON s_suppkey = page_id),
c AS (SELECT page_id, 0 AS ord, 'https://s.example/og.jpg' AS url, '' AS alt, 'meta' AS hint, CASE WHEN m THEN 2 + 1 ELSE 0 END + 1 + 1 AS score FROM p WHERE s_suppkey % 5 = 0
UNION ALL SELECT page_id, 1, concat('https://s.example/', CASE WHEN m THEN 'member' ELSE 'news' END, '/p', s_suppkey, '.jpg'), concat(s_name, ' d''Arc > x'), concat('face ', s_name, ' b > a'), CASE WHEN m THEN 4 + 2 + 1 ELSE 0 END + 6 + 3 FROM p
UNION ALL SELECT page_id, 2, 'https://s.example/og.jpg', 'again', concat(' ', s_name, ' b > a'), CASE WHEN m THEN 2 + 1 ELSE 0 END FROM p WHERE s_suppkey % 5 <> 0 AND m
UNION ALL SELECT page_id, 3, concat('https://s.example/', CASE WHEN m THEN 'member' ELSE 'news' END, '/photo/l.png'), 'group', ' ', -60 FROM p WHERE false
UNION ALL SELECT page_id, 4, 'https://s.example/profile/f.webp', 'a "b" c', concat(' '), 4 + CASE WHEN m THEN 2 + 1 ELSE 0 END FROM p WHERE s_suppkey % 3 <> 0
UNION ALL SELECT page_id, 5, concat('https://s.example/', CASE WHEN m THEN 'member' ELSE 'news' END, '/s1.jpg'), 'a "b" c', ' ', CASE WHEN m THEN 4 + 2 + 1 ELSE 0 END FROM p WHERE s_suppkey % 3 <> 0 AND m)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS place, url, alt, score FROM c""")
def page_candidates(s, d):
    """Ranked candidates of whole pages; each page's name is its supplier's."""
    names = read(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("name"))
    return assets.best_candidates(derived(s, d, _SHOWN, "supplier"), names).select("page_id", "place", "url", "alt", "score")


@query("page_attributes", """SELECT page_id, 0 AS ord, concat('p', page_id, '.jpg') AS src, '' AS data_src, concat(s_name, ' d''Arc > x') AS alt FROM (SELECT s_suppkey AS page_id, s_name FROM supplier)
UNION ALL SELECT s_suppkey, 1, '/og.jpg', '', 'again' FROM supplier
UNION ALL SELECT s_suppkey, 2, CASE WHEN s_suppkey % 3 = 0 THEN 'logo.png' ELSE 'data:image/gif;base64,R0' END, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '../profile/f.webp' END, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a "b" c' END FROM supplier""")
def page_attributes(s, d):
    """Images' attributes in quotes of both kinds and bare, beside comments and ends of tags within values."""
    return markup.extract_images(derived(s, d, _SHOWN, "supplier")).select("page_id", "ord", "src", "data_src", "alt")


_SCORED = "SELECT s_suppkey, s_nationkey, s_name, CASE s_suppkey % 6 WHEN 0 THEN 'https://upload.wikimedia.org/a/portrait.jpg' WHEN 1 THEN 'https://x.example/logo.png' WHEN 2 THEN concat('https://x.example/itdb_giinprof/', s_name, '_600.jpg') WHEN 3 THEN '/member/a.jpg' WHEN 4 THEN 'https://x.example/file' ELSE 'https://www.jimin.jp/poster/a.webp' END AS url, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'meeting' END AS alt FROM supplier"


@query("candidate_scores", f"""SELECT s_suppkey,
CASE s_suppkey % 6 WHEN 0 THEN 10 + 4 + 2 + 1 + 6 WHEN 1 THEN -60 WHEN 2 THEN 4 + 2 + 1 + 6 WHEN 3 THEN -100 WHEN 4 THEN -15 ELSE 2 + 1 - 8 - 3 + 4 END AS search,
CASE s_suppkey % 6 WHEN 0 THEN 2 + 3 WHEN 1 THEN -4 WHEN 2 THEN 10 + 2 + 3 WHEN 3 THEN -100 WHEN 4 THEN -10 ELSE 0 END AS roster,
CASE s_suppkey % 6 WHEN 0 THEN 8 WHEN 1 THEN -20 WHEN 3 THEN 8 ELSE 0 END AS photo FROM ({_SCORED})""")
def candidate_scores(s, d):
    """Scores of assets by each of the weight tables."""
    rows = derived(s, d, _SCORED, "supplier")
    score = lambda t, *more: urls.score_candidate(t, F.col("url"), F.col("alt"), F.col("s_name"), *more).alias(t)
    return rows.select("s_suppkey", score("search", F.lit("https://x.example/profile/"), F.lit("meta")), score("roster"), score("photo"))


@query("decoded_pages", "SELECT CAST(s_suppkey AS VARCHAR) AS path, 'shift_jis' AS charset, concat('議員', s_name) AS text FROM supplier")
def decoded_pages(s, d):
    raw = F.concat(F.unhex(F.lit("8b6388f5")), F.encode("s_name", "UTF-8"))  # 議員 in Shift_JIS
    return markup.decode_best(read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), raw.alias("content")), ["議員"])


# ---- streams -----------------------------------------------------------------------------------------------------
def _source(s: SparkSession, events: DataFrame, path: str, files_: int = 1) -> DataFrame:
    """A stream of ``events``, a file after the other."""
    events.repartition(files_).write.mode("append").parquet(path)
    return s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream: DataFrame, path: str, sink, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()


def _half(g: DataFrame):
    """The time halfway between the first and the last answer."""
    first, last = g.agg(F.min("at"), F.max("at")).first()
    return F.lit((first + last) // 2)


def _stream_states(s: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The first half of the answers by a batch replay, the second by a stream that begins there: the start, and all that was written."""
    from kairan.streaming import review

    review.use_state_store(s)
    path, g = new_path(s, name), grades(s, d)
    half = _half(g)
    start = stored(review.warm_state(g.filter(F.col("at") <= half)), "warm")

    def sink(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/out")

    late = g.filter(F.col("at") > half)
    _run(review.stream_state(_source(s, late, f"{path}/in"), start), path, sink)
    return start, s.read.parquet(f"{path}/out")


@query("stream_states", _FOLD + "SELECT user_id, id, reps, minutes, round(stability, 6) AS stability, lapses, status FROM z")
def stream_states(s, d):
    """State of every item, half replayed and half streamed."""
    names = ["user_id", "id", "reps", "interval_min", "stability", "lapses", "status", "epoch"]
    start, out = _stream_states(s, d, "states")
    both = out.select(*names).unionByName(start.withColumn("epoch", F.lit(-1)).select(*names))
    last = ranking.dedup_keep(both, ["user_id", "id"], ["epoch"], keep="last")
    return last.select("user_id", "id", F.col("reps").cast("long").alias("reps"), F.col("interval_min").alias("minutes"), F.round("stability", 6).alias("stability"), F.col("lapses").cast("long").alias("lapses"), "status")


_HALF = """, h AS (SELECT (min("at") + max("at")) // 2 AS half FROM g),
w AS (SELECT *, status = 'mastered' AS m, coalesce(last_value(CASE WHEN grade = 'again' OR status = 'leech' THEN true WHEN grade = 'good' AND streak >= 2 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id, id ORDER BY done), false) AS x FROM t),
b AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id, id ORDER BY done), false) AS m0, coalesce(lag(x) OVER (PARTITION BY user_id, id ORDER BY done), false) AS x0 FROM w)
"""


@query("stream_set_changes", _FOLD + _HALF + """SELECT user_id, id, seq, 'mastered' AS "set", CASE WHEN m THEN 'added' ELSE 'removed' END AS change FROM b, h WHERE m <> m0 AND "at" > half
UNION ALL SELECT user_id, id, seq, 'wrong', CASE WHEN x THEN 'added' ELSE 'removed' END FROM b, h WHERE x <> x0 AND "at" > half""")
def stream_set_changes(s, d):
    """Which answers of the streamed half put items into the mastered and wrong sets or took them out."""
    from kairan.streaming import review

    return review.set_changes(_stream_states(s, d, "changes")[1]).select("user_id", "id", "seq", "set", "change")


@query("stream_counters", f'''SELECT user_id, count(*) AS played, count(*) FILTER (grade <> 'again') AS correct, count(*) FILTER (grade = 'again') AS wrong, count(*) FILTER (grade IN ('hard', 'again')) AS miss_count, max("at") FILTER (grade IN ('hard', 'again')) AS last_miss_at FROM ({GRADES_DUCK}) GROUP BY user_id''')
def stream_counters(s, d):
    """Counters of a stream that brings every answer twice."""
    from kairan.streaming import review

    path, g = new_path(s, "counters"), grades(s, d).withColumn("ts", F.timestamp_millis("at"))
    _source(s, g, f"{path}/in")
    answers = review.distinct_answers(_source(s, g, f"{path}/in"), "36500 days")
    _run(answers, path, review.counters_sink(f"{path}/out"), "append")
    return review.read_counters(s, f"{path}/out")


@query("graded_once_more", _FOLD.replace(f"g AS ({GRADES_DUCK})", f"g AS ({GRADES_DUCK} UNION ALL SELECT user_id, 'quiz', 'items', id, 0, {NOW}, 'good' FROM (SELECT DISTINCT user_id, id FROM ({GRADES_DUCK})))") + f'SELECT user_id, id, reps, minutes, due, round(stability, 6) AS stability, round(difficulty, 6) AS difficulty, lapses, streak, status FROM z WHERE "at" = {NOW}')
def graded_once_more(s, d):
    """Every item's state after one more good answer, by Column functions."""
    st = F.col("next")
    graded = _states(s, d).select("user_id", "id", memory.apply_grade(F.col("state"), F.lit("good"), _now()).alias("next"))
    return graded.select("user_id", "id", st["reps"].cast("long").alias("reps"), st["interval_min"].alias("minutes"), st["due"].alias("due"), F.round(st["stability"], 6).alias("stability"), F.round(st["difficulty"], 6).alias("difficulty"), st["lapses"].cast("long").alias("lapses"), st["consecutive"].cast("long").alias("streak"), st["status"].alias("status"))


@query("continued_states", _FOLD + "SELECT user_id, id, reps, minutes, round(stability, 6) AS stability, lapses, streak, status FROM z")
def continued_states(s, d):
    """States stored after the earlier half of the answers, and gone on from with the later ones only."""
    g = grades(s, d)
    half = _half(g)
    begun = stored(learning.replay(g.filter(F.col("at") <= half)), "begun")
    st = F.col("state")
    return learning.replay(g.filter(F.col("at") > half), start=begun).select("user_id", "id", st["reps"].cast("long").alias("reps"), st["interval_min"].alias("minutes"), F.round(st["stability"], 6).alias("stability"), st["lapses"].cast("long").alias("lapses"), st["consecutive"].cast("long").alias("streak"), st["status"].alias("status"))
