"""Roster rows: normalising, readings, names, filters, exclusion, merging, ids."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairan.functions import rules
from kairan.functions.text import SPACE, compact, compact_name, first_present, present, shorten_role, split_name_kana, stable_id, text, trimmed
from kairan.operators.ranking import dedup_keep, ranked
from kairan.sources.store import stored
from kairan.sources.files import images_array


def _cols(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns] or [F.lit(None).cast("string")]


def normalize_person(df: DataFrame, rules_: str = "app") -> DataFrame:
    """One schema for all roster rows; nameless rows go. ``rules_`` is ``app`` or ``diff``.

    Both take the first non-blank of alias columns, an id above 0 or else ``ord`` + 1, and the reading from its column
    or the name's parentheses. ``app``: party falls back to group, then role; all images; guessed bad images cleared.
    ``diff``: role is the sub-role, role or group, party has no fallback, only the first image counts.
    """
    c = lambda *n: first_present(*_cols(df, *n))
    whole = lambda *n: F.when((v := c(*n).try_cast("double")) > 0, v)
    parts = split_name_kana(F.col("name"))
    number = lambda v: F.when(v == F.floor(v), v.cast("int"))
    ident = F.coalesce(whole("id").cast("long"), F.col("ord") + 1)
    kana = compact(F.coalesce(c("kana", "nameKana", "kanaName"), parts["kana"]))
    group, role, sub = c("group"), c("role", "title", "post", "position"), c("subRole", "detailRole")
    images = images_array(*_cols(df, "images")[:1], *_cols(df, "image")[:1])
    base = df.filter(present(F.col("name")).isNotNull())
    keep = [F.col(x) for x in ("target", "ord") if x in df.columns]
    if rules_ == "diff":
        return base.select(*keep, ident.alias("id"), parts["name"].alias("name"), kana.alias("kana"), text(first_present(*_cols(df, "subRole"), *_cols(df, "role"), *_cols(df, "group"))).alias("role"), text(c("party")).alias("party"), text(c("district", "electoralDistrict", "constituency")).alias("district"), number(whole("terms", "wins")).alias("terms"), F.coalesce(F.try_element_at(images, F.lit(1)), F.lit("")).alias("image"), F.concat_ws(":", ident.cast("string"), compact(parts["name"])).alias("key"))
    guess = F.coalesce(c("aiGuess").try_cast("boolean"), F.lit(False))
    from kairan.functions.urls import is_bad_asset

    shown = F.filter(images, lambda x: ~(guess & is_bad_asset(x)))
    return base.select(*keep, ident.alias("id"), parts["name"].alias("name"), kana.alias("kana"), text(group).alias("group"), text(F.coalesce(c("party"), group, role)).alias("party"), text(c("district", "electoralDistrict", "constituency")).alias("district"), text(role).alias("role"), text(sub).alias("sub_role"), text(c("chamber", "house")).alias("chamber"), whole("terms", "wins", "electedCount").cast("int").alias("terms"), whole("nextElectionYear", "nextElection", "electionYear").cast("int").alias("next_election_year"), shown.alias("images"), guess.alias("ai_guess"))


def derive_kana(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """``kana`` from its column, else from ``lookup`` (``name``, ``kana``) by compact name, else empty."""
    known = dedup_keep(lookup.select(compact_name(F.col("name")).alias("_key"), compact(F.col("kana")).alias("_kana")).filter("_kana <> ''"), ["_key"], ["_kana"])
    joined = df.withColumn("_key", compact_name(F.col("name"))).join(known, "_key", "left")
    return joined.withColumn("kana", F.coalesce(F.nullif(compact(F.col("kana")), F.lit("")), "_kana", F.lit(""))).drop("_key", "_kana")


def group_label(party: str = "party", group: str = "group") -> Column:
    return F.coalesce(present(F.col(party)), present(F.col(group)), F.lit(rules.NO_GROUP))


def group_sizes(df: DataFrame, label: Column) -> DataFrame:
    """``label``, ``n`` of each group; order by n descending, then label."""
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def filter_group(df: DataFrame, labels: list[str], label: Column) -> DataFrame:
    return df.filter(label.isin(labels))


def search(df: DataFrame, query: str, cols: list[str], role_col: str | None = None) -> DataFrame:
    """Rows in which any column (numbers as text; with ``role_col`` its short form too) holds the query; empty: all."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    fields = [text(F.col(c)) for c in cols] + ([text(F.col(role_col)), shorten_role(F.col(role_col))] if role_col else [])
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(f).contains(wanted)
    return df.filter(hit)


def family_name(name: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """First of a spaced name's parts, else an override for the compact name, else empty."""
    parts = F.split(trimmed(name), f"[{SPACE}]+")
    table = F.create_map(*(F.lit(x) for p in (overrides or {}).items() for x in p)) if overrides else None
    other = F.coalesce(F.try_element_at(table, compact(name)), F.lit("")) if table is not None else F.lit("")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise(other)


def name_collisions(df: DataFrame, family: Column, keys: list[str]) -> DataFrame:
    """``family_count`` (rows of the list with that family name; 0 without one) and ``collides``.

    Counts are aggregated and joined back, so a frequent name's rows never meet in one task.
    """
    with_family = df.withColumn("family", family)
    counts = with_family.filter("family <> ''").groupBy(*keys, "family").agg(F.count("*").alias("family_count"))
    joined = with_family.join(counts, [*keys, "family"], "left").withColumn("family_count", F.coalesce("family_count", F.lit(0).cast("long")))
    return joined.withColumn("collides", F.col("family_count") > 1)


def display_name(collided: DataFrame, target: str, mode: str) -> Column:
    """Name shown for a row of ``name_collisions``: the family name if it is nobody else's, with the role's title."""
    full = F.col("name")
    if mode != "entrance":
        return full
    base = F.when((F.col("family") == "") | F.col("collides"), full).otherwise(F.col("family"))
    if target == "viceMinisters":
        return F.concat(base, F.lit("副大臣"))
    if target != "councilorsOfficersList":
        return full
    source = F.regexp_replace(F.coalesce(present(F.col("sub_role")), present(F.col("group")), present(F.col("role")), F.lit("")), r"\s*/\s*参議院$", "")
    out = F.when(source.contains("懲罰委員長"), full)
    for word, title in (("図書館運営小委員長", "図書小委員長"), ("庶務関係小委員長", "庶務小委員長"), ("特別委員長", "特別委員長"), ("調査会長", "調査会長"), ("審査会会長", "審査会会長"), ("審査会長", "審査会会長")):
        out = out.when(source.contains(word), F.concat(base, F.lit(title)))
    return out.when(source.endswith("委員長"), source).otherwise(full)


def _without_chamber(col: Column) -> Column:
    return trimmed(F.regexp_replace(text(col), r"\s*/\s*(参議院|衆議院)$", ""))


_OFFICERS = ("viceMinisters", "parliamentarySecretaries", "councilorsOfficersList", "houseOfficersList")


def answer_lines(target: str, mode: str) -> Column:
    """Array of the answer's lines for rows with name, kana, party, group, role, sub_role; empty lines are left out."""
    group = _without_chamber(first_present(F.col("party"), F.col("group")))
    order = ("role", "sub_role", "group", "party") if target == "ministers" else ("sub_role", "role", "group", "party") if target in _OFFICERS else ("role", "sub_role", "party", "group")
    role = _without_chamber(first_present(*(F.col(c) for c in order)))
    named = F.when(text(F.col("kana")) != "", F.concat("name", F.lit("（"), "kana", F.lit("）"))).otherwise(F.col("name"))
    some = lambda a, b: F.when(a != "", a).otherwise(b)
    detail = some(role, group) if mode == "entrance" or target in ("ministers", *_OFFICERS) else group
    if mode != "entrance":
        lines = F.array(some(detail, named))
    elif target in ("senators", "representatives"):
        lines = F.array(group)
    elif target in ("ministers", "parliamentarySecretaries"):
        lines = F.array(detail)
    elif target == "viceMinisters":
        lines = F.array(named, detail)
    elif target in _OFFICERS:
        source = _without_chamber(first_present(F.col("sub_role"), F.col("group"), F.col("role")))
        plain = source.endswith("委員長") & ~source.rlike("懲罰委員長|特別委員長|調査会長|審査会会長|審査会長")
        lines = F.when(detail == "懲罰委員長", F.array(detail)).when(plain, F.array(named)).otherwise(F.array(named, detail))
    else:
        lines = F.array(some(detail, group))
    return F.filter(lines, lambda x: x != "")


def exclude_holders(rows: DataFrame, related: Mapping[str, DataFrame], target: str) -> DataFrame:
    """Rows of ``target`` without the people that hold the posts of ``related`` rosters (by compact name)."""
    joined = lambda df, *cols: compact(F.concat_ws(" / ", *(present(F.col(c)) for c in cols)))
    key = lambda df: df.select(compact(F.col("name")).alias("_key"))
    posts = [related[t] for t in ("ministers", "viceMinisters", "parliamentarySecretaries") if t in related]
    if target == "houseOfficersList":
        return rows.limit(0)
    if target == "parliamentarySecretaries":
        return rows.filter(joined(rows, "group", "party").contains("衆議院"))
    if target == "senators":
        gone = [key(p.filter(joined(p, "group", "party", "district", "role", "sub_role", "chamber").contains("参議院"))) for p in posts]
        gone += [key(related["councilorsOfficersList"])] if "councilorsOfficersList" in related else []
    elif target == "representatives":
        gone = [key(related[t]) for t in ("viceMinisters", "parliamentarySecretaries") if t in related]
        gone += [key(p.filter(joined(p, "group", "party", "district").contains("衆議院"))) for p in ([related["ministers"]] if "ministers" in related else [])]
    else:
        return rows
    if not gone:
        return rows
    names = gone[0]
    for g in gone[1:]:
        names = names.unionByName(g)
    return rows.withColumn("_key", compact(F.col("name"))).join(names.distinct(), "_key", "left_anti").drop("_key")


def _blank(col: Column, kind: str) -> Column:
    return F.when(F.size(col) > 0, col) if kind.startswith("array") else F.when(trimmed(col) != "", col) if kind == "string" else col


def merge_keep(new: DataFrame, old: DataFrame, keys: list[str], id_prefix: str | None = None) -> DataFrame:
    """New rows win field by field, blank fields keep the old value; old rows without a new one stay, as ``seed``.

    With ``id_prefix`` ids are recomputed from the keys. Both sides count once a key, the first by ``ord``.
    """
    fields = [c for c in new.columns if c not in (*keys, "ord")]
    kinds = dict(new.dtypes)
    a = dedup_keep(new, keys, ["ord"]).select(*keys, F.col("ord").alias("_a"), *(F.col(c).alias(f"_n_{c}") for c in fields))
    b = dedup_keep(old, keys, ["ord"]).select(*keys, F.col("ord").alias("_b"), *(F.col(c).alias(f"_o_{c}") for c in fields if c in old.columns))
    both = a.join(b, keys, "full_outer")
    value = lambda c: F.coalesce(_blank(F.col(f"_n_{c}"), kinds[c]), *([F.col(f"_o_{c}")] if f"_o_{c}" in both.columns else [])).alias(c)
    out = both.select(*keys, *(value(c) for c in fields), F.coalesce("_a", "_b").alias("ord"), F.when(F.col("_a").isNull(), "seed").otherwise("live").alias("source_mode"))
    return out.withColumn("id", stable_id(F.lit(id_prefix), *(F.col(k) for k in keys))) if id_prefix is not None else out


def enrich(rows: DataFrame, members: list[DataFrame], fields: tuple[str, ...] = ("district", "terms")) -> DataFrame:
    """Fields by compact name; a later member list overrides an earlier one, a row's own value stays without a match."""
    union = None
    for i, m in enumerate(members):
        part = m.select(compact_name(F.col("name")).alias("_key"), F.lit(i).alias("_rank"), F.col("ord").alias("_ord"), *(F.col(f).alias(f"_{f}") for f in fields))
        union = part if union is None else union.unionByName(part)
    last = dedup_keep(union.filter("_key <> ''"), ["_key"], ["_rank", "_ord"], keep="last").drop("_rank", "_ord")
    joined = rows.withColumn("_key", compact_name(F.col("name"))).join(last, "_key", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) if f in rows.columns else F.col(f"_{f}") for f in fields}).drop("_key", *(f"_{f}" for f in fields))


def apply_overrides(rows: DataFrame, overrides: DataFrame, keys: list[str], fields: tuple[str, ...], provenance: tuple[str, str] | None = None) -> DataFrame:
    """Non-blank override values replace the rows' (and set a provenance column); the last override a key counts."""
    last = dedup_keep(overrides, keys, ["ord"], keep="last").select(*keys, *(present(F.col(f)).alias(f"_{f}") for f in fields))
    out = rows.join(last, keys, "left")
    if provenance:
        any_ = F.coalesce(*(F.col(f"_{f}") for f in fields)).isNotNull()
        out = out.withColumn(provenance[0], F.when(any_, provenance[1]).otherwise(F.col(provenance[0])))
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def carry_forward(new: DataFrame, old: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """New rows take over ``fields`` of the old row of the same name and reading where they have none."""
    key = F.concat_ws("__", compact(F.col("name")), compact(F.col("kana")))
    kinds = dict(new.dtypes)
    before = dedup_keep(old.withColumn("_key", key), ["_key"], ["ord"], keep="last").select("_key", *(F.col(f).alias(f"_{f}") for f in fields))
    joined = new.withColumn("_key", key).join(before, "_key", "left")
    return joined.withColumns({f: F.coalesce(_blank(F.col(f), kinds[f]), F.col(f"_{f}")) for f in fields}).drop("_key", *(f"_{f}" for f in fields))


def assign_ids(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Rows with an id keep it; others get the greatest id + 1, + 2 … in ``order``, by range offsets, not one window."""
    top = rows.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    lacking = ranked(rows.filter(F.col(id_col).isNull()), [], [F.col(c).asc() for c in order], "_n").crossJoin(F.broadcast(top))
    filled = lacking.withColumn(id_col, (F.col("_top") + F.col("_n")).cast(dict(rows.dtypes)[id_col])).select(*rows.columns)
    return rows.filter(F.col(id_col).isNotNull()).unionByName(filled)


def choose_route(a: DataFrame, b: DataFrame, low: int, high: int, keys: list[str]) -> DataFrame:
    """``a`` if its count is in range, else ``b`` if its is, else the deduped union if that is, else an error.

    Both are stored first: the rows counted are the rows returned, and nothing is computed twice.
    """
    a, b = stored(a, "route-a"), stored(b, "route-b")
    counts = a.select(F.lit(0).alias("side")).unionByName(b.select(F.lit(1).alias("side"))).groupBy("side").count().collect()
    n = {r["side"]: r["count"] for r in counts}
    for side, df in ((0, a), (1, b)):
        if low <= n.get(side, 0) <= high:
            return df
    both = dedup_keep(a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1))), keys, ["_s", "ord"]).drop("_s")
    total = both.count()
    if low <= total <= high:
        return both
    raise ValueError(f"{total} rows, expected {low} to {high}")
