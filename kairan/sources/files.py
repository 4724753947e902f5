"""Readers and writers: rosters, asset lists, keyed JSON, review CSV, snapshots, feeds, key-value backups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairan.functions.text import trimmed
from kairan.sources.ranges import RANGE_BYTES, read_elements

_TEXT = ("name kana nameKana kanaName group party role subRole detailRole title post position district electoralDistrict constituency chamber house image imageSource imageSourceUrl imageStatus profileUrl sourceUrl sourceMode id terms wins electedCount nextElectionYear nextElection electionYear aiGuess").split()
#: Superset of all roster fields, read as text: one list, no inference; a field that isn't there is null.
ROSTER_FIELDS = (*_TEXT, "images", "imageCandidates")
REVIEW_COLUMNS = ("name", "party", "status", "reason", "profileUrl", "currentImage", "imageSource", "imageSourceUrl", "preferredSourceType", "searchHints", "checkedSources", "candidatePageUrls", "notes")


def read_roster(spark: SparkSession, path: str, target: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of JSON array files with ``target`` and ``ord`` (place in the array); unreadable content gives no rows.

    Elements that aren't objects have no name and go; arrays come as JSON text. Files are read by byte ranges (see
    ``ranges``), so one may be of any size.
    """
    items = read_elements(spark, path, "[", range_bytes)
    fields = [F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in ROSTER_FIELDS]
    return items.select(*fields, "ord", F.lit(target).alias("target")).filter("name is not null")


def images_array(images, image):
    """String-or-array images as an array of non-blank strings; ``images`` wins over ``image``."""
    source = F.coalesce(images, image)
    listed = F.when(source.startswith("["), F.from_json(source, "array<string>")).otherwise(F.array(source))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), trimmed), lambda x: x != "")


def read_asset_pool(spark: SparkSession, path: str, pattern: str = r"/([^/]+)_0\.jpg") -> DataFrame:
    """``id`` (upper-case, from the file name), ``image``: distinct non-blank lines of a URL list."""
    lines = spark.read.text(path).select(trimmed(F.col("value")).alias("image")).filter("image <> ''").distinct()
    return lines.select(F.upper(F.regexp_extract("image", pattern, 1)).alias("id"), "image")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``key``, ``value`` of JSON objects, read by byte ranges; keys that start with ``_`` are skipped."""
    items = read_elements(spark, path, "{", range_bytes)
    pairs = items.select(F.explode(F.try_variant_get("v", "$", f"map<string,{value_schema}>")).alias("key", "value"))
    return pairs.filter(~F.col("key").startswith("_"))


def review_csv_rows(df: DataFrame, columns: tuple[str, ...] = REVIEW_COLUMNS) -> DataFrame:
    """The review columns as text; arrays joined with `` | ``, missing values empty."""
    kinds = dict(df.dtypes)
    return df.select(*(F.coalesce(F.concat_ws(" | ", c) if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def write_review_csv(df: DataFrame, path: str, columns: tuple[str, ...] = REVIEW_COLUMNS) -> None:
    """Every value quoted, quotes doubled, a header line."""
    review_csv_rows(df, columns).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', emptyValue="").csv(path)


#: The file beside a base's snapshots that names the current one and the one before it.
CURRENT = "CURRENT.json"


def _marked(spark: SparkSession, base: str) -> dict[str, str | None]:
    """What the base's commit file says; nothing where there is none."""
    jvm, where = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{CURRENT}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {"current": None, "previous": None}
    stream = fs.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _mark(spark: SparkSession, base: str, content: dict[str, str | None]) -> None:
    """Write the commit file beside and put it in place by one rename, so that readers see the old or the new one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    made, where = path(f"{base.rstrip('/')}/.{CURRENT}.{uuid.uuid4().hex}"), path(f"{base.rstrip('/')}/{CURRENT}")
    stream = made.getFileSystem(conf).create(made, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(made, where, options)


def publish_snapshot(df: DataFrame, base: str, snapshot_id: str) -> DataFrame:
    """Write a new snapshot folder under ``base`` and make it the current one; one row: total, with_image, missing.

    Earlier folders stay as backups. Only once all rows are written does the base's commit file name the new folder and,
    as previous, the one that was current; if writing fails, the old one stays current.
    """
    spark, path = df.sparkSession, f"{base.rstrip('/')}/snapshot={snapshot_id}"
    df.write.mode("errorifexists").json(path)
    before = _marked(spark, base)["current"]
    _mark(spark, base, {"current": snapshot_id, "previous": before})
    back = spark.read.schema(df.schema).json(path)
    has = F.coalesce(trimmed(F.col("image")) != "", F.lit(False))
    return back.agg(F.count("*").alias("total"), F.count_if(has).alias("with_image"), F.count_if(~has).alias("missing"))


def read_snapshot(spark: SparkSession, base: str, schema, which: str = "current") -> DataFrame:
    """The rows of a base's ``current`` or ``previous`` snapshot; no rows where there is none."""
    name = _marked(spark, base)[which]
    if name is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{base.rstrip('/')}/snapshot={name}")


def bucketed_snapshot(df: DataFrame, name: str, path: str, keys: tuple[str, ...] = ("target", "key"), buckets: int = 16) -> DataFrame:
    """``df`` as a table in buckets by ``keys``; snapshots with as many buckets are compared without a shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def build_feed(items: DataFrame, summaries: DataFrame, generated_at: str, notices: DataFrame | None = None) -> DataFrame:
    """One row: generatedAt, totalChanges (of ``items``), hasUpdates, summaries, items in order of ``ord``; notices first."""
    fields = [c for c in items.columns if c != "ord"]
    ranked = items.select(F.lit(1).alias("rank"), "ord", F.struct(*fields).alias("item"))
    if notices is not None:
        ranked = notices.select(F.lit(0).alias("rank"), "ord", F.struct(*(F.col(c) if c in notices.columns else F.lit(None).cast(dict(items.dtypes)[c]).alias(c) for c in fields)).alias("item")).unionByName(ranked)
    ordered = lambda name, *key: F.transform(F.array_sort(F.collect_list(F.struct(*key, name))), lambda x: x[name])
    listed = ranked.agg(F.count_if(F.col("rank") == 1).alias("totalChanges"), F.count("*").alias("n"), ordered("item", "rank", "ord").alias("items"))
    kept = [c for c in summaries.columns if c != "ord"]
    sums = summaries.select("ord", F.struct(*kept).alias("s")).agg(ordered("s", "ord").alias("summaries"))
    return listed.crossJoin(sums).select(F.lit(generated_at).alias("generatedAt"), "totalChanges", (F.col("n") > 0).alias("hasUpdates"), "summaries", "items")


def export_state(kv: DataFrame, prefix: str, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """One row a user (``by``), ``json``: the user's pairs ``key``, ``value`` whose key has the prefix."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    own = kv.filter(F.col("key").startswith(prefix)).groupBy(*by, "key").agg(F.max("value").alias("value"))
    return own.groupBy(*by).agg(F.to_json(pairs).alias("json"))


def import_state(df: DataFrame, prefix: str) -> DataFrame:
    """Pairs of JSON objects in ``json`` with the prefix, beside the other columns; only string values count."""
    others = [c for c in df.columns if c not in ("json", "key", "value")]
    keyed = df.select(*others, F.explode(F.from_json("json", "map<string,variant>")).alias("key", "value"))
    strings = keyed.filter(F.schema_of_variant("value") == "STRING")
    return strings.select(*others, "key", F.variant_get("value", "$", "string").alias("value")).filter(F.col("key").startswith(prefix))
