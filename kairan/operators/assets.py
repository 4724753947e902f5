"""Assets of roster rows: rejecting, work queues, flags, classes, reasons, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.functions import rules
from kairan.functions.text import compact_name, squeezed, text
from kairan.functions.urls import block_reason, in_text, normalize_url, score_asset, score_candidate
from kairan.operators.markup import collect_images
from kairan.operators.ranking import dedup_keep, ranked


def has_asset(image: str = "image") -> Column:
    return squeezed(F.col(image)) != ""


def reject_source(df: DataFrame, pattern: str) -> DataFrame:
    """Clear assets and candidates that fit ``pattern``; status becomes review or missing; ``cleared`` and ``removed`` tell."""
    bad = F.lower(text(F.col("image"))).rlike(pattern) | F.lower(text(F.col("image_source"))).rlike(pattern)
    kept = F.filter("image_candidates", lambda x: ~F.lower(x).rlike(pattern))
    out = df.withColumns({"cleared": bad, "removed": F.size("image_candidates") - F.size(kept), "image_candidates": kept})
    status = F.when(F.col("cleared"), F.when(F.size("image_candidates") > 0, "review").otherwise("missing")).otherwise(F.col("image_status"))
    return out.withColumns({"image_status": status, "image": F.when(F.col("cleared"), "").otherwise(F.col("image")), "image_source": F.when(F.col("cleared"), "").otherwise(F.col("image_source"))})


def rejection_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("cleared").alias("cleared"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"), F.count_if(F.col("cleared") | (F.col("removed") > 0)).alias("changed"))


def work_queue(df: DataFrame, mode: str, fix: DataFrame | None = None, sources_remain: Column | None = None, limit: int = 25, order: str = "ord") -> DataFrame:
    """The first ``limit`` rows to work on: ``all``, ``review`` (guessed assets), ``fix`` (listed names), ``missing``."""
    if mode == "review":
        rows = df.filter(has_asset() & F.col("ai_guess"))
    elif mode == "fix":
        rows = df.join(fix.select("name").distinct(), "name", "left_semi")
    elif mode == "missing":
        rows = df.filter(~has_asset() & (sources_remain if sources_remain is not None else F.lit(True)))
    else:
        rows = df
    return rows.orderBy(order).limit(limit)


def relevance(body: Column, name: Column, tokens: tuple[str, ...] = rules.PAGE_TOKENS) -> Column:
    """4 points for the name, 1 for each token; a page counts from 4 on."""
    hay, score = squeezed(body), F.lit(0)
    score = F.when((name != "") & F.contains(hay, name), 4).otherwise(0)
    for t in tokens:
        score = score + F.when(hay.contains(t), 1).otherwise(0)
    return score


def relevant_pages(df: DataFrame, body: Column, name: Column, tokens: tuple[str, ...] = rules.PAGE_TOKENS, least: int = 4) -> DataFrame:
    return df.withColumn("relevance", relevance(body, name, tokens)).filter(F.col("relevance") >= least)


def asset_flags(df: DataFrame) -> DataFrame:
    """``ai_guess`` unless the source is trusted, ``source_type``, ``mask_bottom`` and ``mask_mode``."""
    hay = F.lower(F.concat_ws(" ", *(F.col(c) for c in ("image_source", "image", "image_source_url", "party", "role"))))
    guess = ~F.coalesce(F.col("image_source").isin(*rules.TRUSTED_SOURCES), F.lit(False))
    out = df.withColumns({"ai_guess": guess, "mask_bottom": hay.rlike(f"(?i){rules.MASK_PATTERN}")})
    return out.withColumns({"source_type": F.when(F.col("ai_guess"), "estimated").otherwise("verified"), "mask_mode": F.when(F.col("mask_bottom"), "pixelate-bottom").otherwise("none")})


def quality_class(image: Column, status: Column) -> Column:
    """No asset: missing; status review or a score of 10 or more: review; else ok."""
    return F.when(F.trim(text(image)) == "", "missing").when((text(status) == "review") | (score_asset(F.trim(text(image))) >= 10), "review").otherwise("ok")


def quality_summary(df: DataFrame, image: str = "image", status: str = "image_status") -> DataFrame:
    k = quality_class(F.col(image), F.col(status))
    n = lambda x: F.count_if(k == x).alias(x)
    return df.agg(F.count("*").alias("total"), n("ok"), n("review"), n("missing"))


def review_reason(table=rules.REVIEW_REASONS) -> Column:
    """The first reason of ``table`` whose fields fit its pattern (or whose flag is set); ``no_image`` goes before all."""
    hay = lambda fields: F.lower(F.concat_ws(" ", *(text(F.col(c)) for c in fields)))
    out = F.when(~has_asset(), "no_image")
    for name, fields, pattern in table:
        out = out.when(hay(fields).rlike(pattern) if fields else F.col(pattern), name)
    far = hay(("image_source",)).rlike("wikipedia") & hay(("image", "image_source_url")).rlike(rules.FAR_PATTERN)
    return out.when(far, rules.FAR_REASON).otherwise("manual_review")


def review_list(df: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Rows to review with reason, status and known source pages; reasons that ask for nothing are left out."""
    out = df.withColumn("reason", review_reason()).filter(~F.col("reason").isin("manual_review", "manual_source_page"))
    out = out.withColumn("status", F.when(has_asset(), "review").otherwise("missing"))
    if pages is None:
        return out
    return out.join(pages.select(F.col("key").alias("name"), F.col("value").alias("known")), "name", "left").withColumn("preferred_source_type", F.coalesce("known.preferredSourceType", F.lit("official_or_party")))


def source_counts(df: DataFrame) -> DataFrame:
    """Rows by kind of source: official, wikipedia, cached, web, empty."""
    s = F.lower(text(F.col("image_source")))
    kind = F.when(~has_asset(), "empty").when(s.rlike("official|party|manual"), "official").when(s.rlike("wiki"), "wikipedia").when(s.rlike("cache|existing"), "cached").otherwise("web")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def scan_report(pages: DataFrame, cands: DataFrame) -> DataFrame:
    """``page_id``, ``n_candidates`` of every page, 0 included."""
    counts = cands.groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"))


def scan_totals(report: DataFrame, rows: DataFrame, status: str = "image_status", failed: str | None = None) -> DataFrame:
    """One row: ``pages``, ``scanned`` (those that didn't fail), ``candidates``, ``applied``, ``review``, ``missing``.

    ``report`` is a ``scan_report``, with a column ``failed`` if pages can fail; ``rows`` have the status after matching.
    """
    read = ~F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(True)
    pages = report.agg(F.count("*").alias("pages"), F.count_if(read).alias("scanned"), F.coalesce(F.sum(F.when(read, F.col("n_candidates"))), F.lit(0)).alias("candidates"))
    n = lambda name, value: F.count_if(text(F.col(status)) == value).alias(name)
    return pages.crossJoin(rows.agg(n("applied", "ok"), n("review", "review"), n("missing", "missing")))  # a row each


def source_state(log: DataFrame, entities: DataFrame, sources: tuple[str, ...] = rules.SOURCE_ORDER) -> DataFrame:
    """``entity``, ``sources_remain``: some source of the list isn't known as not found by its latest state."""
    latest = log.filter(F.col("source").isin(*sources)).groupBy("entity", "source").agg(F.max_by("state", F.struct("at", "state")).alias("state"))
    gone = latest.groupBy("entity").agg(F.count_if(F.col("state") == "not_found").alias("gone"))
    return entities.select("entity").distinct().join(gone, "entity", "left").select("entity", (F.coalesce("gone", F.lit(0)) < len(sources)).alias("sources_remain"))


def remaining(df: DataFrame) -> DataFrame:
    """Rows still without an asset."""
    return df.filter(~has_asset())


def search_worklist(df: DataFrame, suffixes: tuple[str, str, str] = (" 衆議院 顔", " プロフィール", " 公式")) -> DataFrame:
    """Running ``index`` in order of ``ord``, and three query strings."""
    numbered = ranked(df.withColumn("_name", F.trim(text(F.col("name")))), [], [F.col("ord").asc()], "index")
    return numbered.select("index", F.col("_name").alias("name"), *(F.concat("_name", F.lit(s)).alias(n) for n, s in zip(("query", "query_alt1", "query_alt2"), suffixes, strict=True)))


def page_candidates(images: DataFrame, names: DataFrame, page_weight: Column | int = 0, page: Column | None = None, hint: str | None = None) -> DataFrame:
    """Images of pages scored for a name, above 0 only: the search table's score and the page's weight.

    The name in URL or text gives 3 more, a ``meta`` image and a page about members 1 more each.
    """
    joined = images.join(names, "page_id")
    hints = F.col(hint) if hint else F.lit("")
    hay = F.regexp_replace(F.concat_ws(" ", "url", "alt"), r"[\s\-_]", "")
    more = F.when(in_text(hay, compact_name(F.col("name"))), 3).otherwise(0) + F.when(hints == "meta", 1).otherwise(0)
    more = more + (F.when(F.lower(page).rlike("member|profile|politician|giin"), 1).otherwise(0) if page is not None else F.lit(0))
    first = score_candidate("search", F.col("url"), F.col("alt"), F.col("name"), page, hints) + page_weight
    return joined.withColumn("score", F.when(first > 0, first + more)).filter("score > 0")


def best_candidates(pages: DataFrame, names: DataFrame, page_weight: Column | int = 0, known_bad: DataFrame | None = None) -> DataFrame:
    """Candidates from whole pages (``page_id``, ``url``, ``html``) for the page's name, ranked.

    ``page_id``, ``place`` from 1, ``url``, ``alt``, ``hint``, ``score``: images of ``markup.collect_images`` by absolute
    URL, each once a page, where it stands first; blocked ones and URLs of ``known_bad`` are out; best score first, then
    in order of the page.
    """
    images = collect_images(pages).join(pages.select("page_id", F.col("url").alias("page")), "page_id")
    # spread from an array, so that filters and scores see a column and don't repeat how it is made
    usable = F.filter(F.array(normalize_url(F.col("src"), F.col("page"))), lambda u: (u != "") & (block_reason(u) == ""))
    images = images.withColumn("url", F.explode(usable))
    if known_bad is not None:
        images = images.join(known_bad.select("url").distinct(), "url", "left_anti")
    once = dedup_keep(images, ["page_id", "url"], ["ord"])
    scored = page_candidates(once, names, page_weight, F.col("page"), "hint")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "ord"))
    return scored.select("page_id", place.alias("place"), "url", "alt", "hint", "score")
