"""Tables that the registered queries derive from the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")

#: Rosters: customers and suppliers as people of two kinds.
CURR = """
SELECT 'senators' AS target, c_custkey AS ord, c_custkey + 1 AS id, c_name AS name, '' AS kana, concat('role ', cast(c_nationkey AS string)) AS role, c_mktsegment AS party, concat('NATION_', cast(c_nationkey AS string)) AS district, CASE WHEN c_acctbal > 0 THEN cast(floor(c_acctbal / 1000) AS int) END AS terms, concat('https://img.example.org/', cast(c_custkey AS string), '.jpg') AS image, concat(cast(c_custkey + 1 AS string), ':', c_name) AS key FROM customer
UNION ALL
SELECT 'representatives' AS target, s_suppkey AS ord, s_suppkey + 1 AS id, s_name AS name, '' AS kana, 'member' AS role, concat('P', cast(s_nationkey % 4 AS string)) AS party, concat('NATION_', cast(s_nationkey AS string)) AS district, cast(floor(abs(s_acctbal) / 1000) AS int) AS terms, '' AS image, concat(cast(s_suppkey + 1 AS string), ':', s_name) AS key FROM supplier"""
#: The snapshot before: every 17th row isn't there, every 13th has another name, every 11th another party, 23rds are gone now.
PREV = f"""
SELECT target, ord, id, CASE WHEN id % 13 = 0 THEN concat(name, 'X') ELSE name END AS name, kana, role, CASE WHEN id % 11 = 0 THEN 'OTHER' ELSE party END AS party, district, terms, CASE WHEN id % 19 = 0 THEN '' ELSE image END AS image, concat(cast(id AS string), ':', CASE WHEN id % 13 = 0 THEN concat(name, 'X') ELSE name END) AS key FROM ({CURR}) c WHERE id % 17 <> 0
UNION ALL
SELECT target, ord + 10000000 AS ord, id + 10000000 AS id, name, kana, role, party, district, terms, image, concat(cast(id + 10000000 AS string), ':', name) AS key FROM ({CURR}) g WHERE id % 23 = 0"""
#: People with Japanese names: digits stand for characters in old and new forms.
PEOPLE = """
SELECT c_custkey AS ord, c_custkey + 1 AS id, 'senators' AS target, concat(translate(lpad(cast(c_custkey % 1000 AS string), 3, '0'), '0123456789', '髙高邊邉辺澤沢廣広徳'), '　', translate(cast(c_custkey % 37 AS string), '0123456789', '一二三四五六七八九十'), CASE c_custkey % 4 WHEN 0 THEN '（やまだ　たろう）' WHEN 1 THEN '(サトウ)' WHEN 2 THEN '君' ELSE '' END) AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS party, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('会派', cast(c_nationkey AS string)) END AS grp, CASE c_custkey % 6 WHEN 0 THEN '選挙区：東京' WHEN 1 THEN '比例（全国）' WHEN 2 THEN '北海道選挙区' WHEN 3 THEN '' WHEN 4 THEN '長野・新潟' ELSE c_mktsegment END AS district, CASE c_custkey % 4 WHEN 0 THEN '内閣総理大臣 / 衆議院' WHEN 1 THEN '文部科学大臣政務官 /参議院/ 厚生労働副大臣' WHEN 2 THEN '' ELSE '沖縄及び北方問題に関する特別委員長' END AS role, CASE c_custkey % 3 WHEN 0 THEN '参議院' ELSE '衆議院' END AS chamber, CASE c_custkey % 5 WHEN 0 THEN '令和7年' WHEN 1 THEN '2028年' WHEN 2 THEN '令和１０年' ELSE 'なし' END AS era, CASE WHEN c_acctbal > 0 THEN cast(floor(c_acctbal / 1000) AS int) END AS terms FROM customer"""
#: Assets of people: some missing, placeholders, encyclopaedia thumbnails, posters.
ASSETS = """
SELECT c_custkey AS ord, c_name AS name, c_mktsegment AS party, 'member' AS role, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://upload.wikimedia.org/thumb/a.jpg' WHEN 2 THEN 'https://www.sangiin.go.jp/p.jpg' WHEN 3 THEN 'https://x.example/noimage.png' WHEN 4 THEN 'https://x.example/poster/9.jpg' ELSE concat('https://x.example/', cast(c_custkey AS string), '.jpg') END AS image, CASE c_custkey % 5 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'web-fallback' WHEN 2 THEN 'official-profile' WHEN 3 THEN 'trusted-fallback' ELSE '' END AS image_source, CASE WHEN c_custkey % 9 = 0 THEN 'https://youtube.example/v' ELSE '' END AS image_source_url, CASE WHEN c_custkey % 10 = 0 THEN 'review' ELSE '' END AS image_status, c_custkey % 11 = 0 AS ai_guess FROM customer"""
#: Graded answers: learners' events as grades; milliseconds since 1970.
GRADES = """
SELECT user_id, 'quiz' AS mode, 'items' AS target, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS id, event_id AS seq, {ms} AS {at}, CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'strong' WHEN 'purchase' THEN 'good' WHEN 'signup' THEN 'hard' ELSE 'again' END AS grade FROM events"""
NOW = 1_710_000_000_000


def open_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the given tables as temporary views."""
    for n in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    open_tables(spark, sf_dir, *names)
    return spark.sql(sql)


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ``ts`` has no zone: read as UTC whatever the session's zone is
    ms = "unix_millis(to_utc_timestamp(cast(ts AS timestamp), current_timezone()))"
    return derived(spark, sf_dir, GRADES.format(ms=ms, at="at"), "events")


GRADES_DUCK = GRADES.format(ms="epoch_us(ts) // 1000", at='"at"')
