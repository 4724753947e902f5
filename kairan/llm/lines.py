"""Line dedup by site-relative frequency.

Lines that stand on more than a given share of a site's pages are boilerplate of that site and go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: A line that surely stands on more than this share of its host's pages is boilerplate ...
RATIO = 0.01
#: ... where "surely" takes so many standard errors from the number of its pages (95 % sure): on a small host a share of a
#: few pages says little, on a large one the ratio itself decides.
SURE = 1.645
#: Parts that a hot host is dealt to, where the lists of boilerplate are too large to broadcast.
SALTS = 64


def _key(line: Column) -> Column:
    """128 bits of a line without outer blanks; they stand for the line in shuffles."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO) -> DataFrame:
    """Per host the keys of its boilerplate lines: ``host``, ``listed`` array.

    A line's pages over its host's pages is its share, whose lower bound must be over ``ratio``. A host has at most (mean
    lines a page) / ratio of them, whatever its size, so the arrays are bounded. Counting aggregates within each task
    before the shuffle, so a hot host or line costs a row a task.
    """
    page = pages.select(F.coalesce(pages[host_col].cast("string"), F.lit("")).alias("host"), pages[text_col].alias("text"))
    split = page.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).filter("line <> ''")
    counted = split.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))
    totals = page.groupBy("host").agg(F.count("*").alias("total"))
    often = counted.join(totals, "host").filter(F.col("n") - SURE * F.sqrt("n") > ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("key").alias("listed"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``; with ``counts`` also ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n`` and are compared without outer spaces; a line counts once a page; blank lines are neither
    counted nor dropped. Rows are pages. A null host is the host ``""``. A null text stays null (no lines). A text that
    would lose all its lines keeps them: it is one of many copies of a page, which isn't boilerplate, and nothing of it
    would be left for near-dedup to tell. A text without boilerplate stays as it is. An
    empty table stays empty. All columns of ``docs`` come back; ``counts`` columns replace columns of these names.
    """
    listed = stored(boilerplate(docs, host_col, text_col, ratio).withColumnsRenamed({"host": "__host", "listed": "__listed"}), "boilerplate")
    host = F.coalesce(docs[host_col].cast("string"), F.lit(""))
    size = listed.agg(F.coalesce(F.sum(F.size("__listed") + 1), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        joined = docs.withColumn("__at", host).join(F.broadcast(listed), F.col("__at") == F.col("__host"), "left")
    else:
        salted = listed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64(docs[text_col]), F.lit(SALTS)).cast("int")
        joined = docs.withColumns({"__at": host, "__salt": part}).join(salted, (F.col("__at") == F.col("__host")) & (F.col("__salt") == F.col("__part")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__listed"), _key(x)))
    some = lambda x: F.exists(x, lambda y: F.trim(y) != "")
    marked = joined.withColumn("__kept", F.when(F.col("__listed").isNotNull(), kept))
    marked = marked.withColumn("__kept", F.when(some("__kept"), F.col("__kept")).when(F.col("__kept").isNotNull(), lines))
    full = lambda x: F.coalesce(F.size(F.filter(x, lambda y: F.trim(y) != "")), F.lit(0)).cast("long")
    text = F.when(F.size("__kept") < F.size(lines), F.array_join("__kept", "\n")).otherwise(F.col(text_col))
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    if counts:
        out += [full(lines).alias("n_lines"), F.when(F.col("__kept").isNotNull(), full(lines) - full(F.col("__kept"))).otherwise(F.lit(0).cast("long")).alias("n_dropped")]
    return marked.select(*out)


#: DuckDB's words for the text that remains of the table ``{docs}``; for the default columns and parameters.
SQL = """
pages_of AS (SELECT coalesce(source, '') AS source_of, text FROM {docs}),
lined AS (SELECT source_of, line FROM (SELECT source_of, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM pages_of) WHERE line <> ''),
totals AS (SELECT source_of, count(*) AS total FROM pages_of GROUP BY 1),
often AS (SELECT source_of, line FROM lined JOIN totals USING (source_of) GROUP BY source_of, line HAVING count(*) - 1.645::DOUBLE * sqrt(count(*)) > 0.01::DOUBLE * any_value(total)),
listed AS (SELECT source_of, list(line) AS gone FROM often GROUP BY 1),
split AS (SELECT d.*, string_split(text, chr(10)) AS lines, gone FROM {docs} d LEFT JOIN listed ON source_of = coalesce(source, '')),
sifted AS (SELECT *, list_filter(lines, lambda x: trim(x) = '' OR gone IS NULL OR NOT list_contains(gone, trim(x))) AS sifted_lines FROM split),
kept AS (SELECT * EXCLUDE (sifted_lines), CASE WHEN len(list_filter(sifted_lines, lambda x: trim(x) <> '')) > 0 THEN sifted_lines ELSE lines END AS kept_lines FROM sifted)
"""
