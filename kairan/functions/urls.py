"""URL and asset functions on Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import SPACE, compact_name, squeezed, text, trimmed

# Patterns of placeholder assets, weights of asset patterns, and patterns of blocked assets with their reasons.
BAD_ASSET = "noimage|no-image|placeholder|default|dummy|blank|icon|silhouette|avatar|sample|comingsoon|nowprinting|notfound"
ASSET_WEIGHTS = ((r"o-ishin\.jp/member/images/member/", -20), (r"shugiin|sangiin|kantei|go\.jp", -10), (r"wikipedia|wikimedia", 8), (r"thumb|thumbnail|small|icon|crop", 8))
BLOCK_REASONS = (("logo", "logo"), ("poster|leaflet|flyer|manifesto|senkyo", "poster"), ("group|集合|allmember|members", "group-photo"), ("text|policy|profile_pdf|pdf", "text-heavy"))


def _without_dots(url: Column) -> Column:
    """A URL whose path's ``.`` and ``..`` are resolved: each ``..`` takes back the folder before it, if there is one."""
    parts = F.split(F.regexp_extract(url, "(?i)^https?://[^/]+/(.*)$", 1), "/")
    ends = F.element_at(parts, -1).isin(".", "..")
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    return F.concat(F.regexp_extract(url, "(?i)^(https?://[^/]+)", 1), F.lit("/"), F.array_join(kept, "/"), F.when(ends & (F.size(kept) > 0), "/").otherwise(""))


def normalize_url(col: Column, base: Column | None = None) -> Column:
    """Absolute URL without query, fragment and double slashes in its path; empty if it can't be one.

    ``data:``, ``javascript:`` and ``mailto:`` references are empty; ``//host`` takes the base's scheme (https without
    one), ``/path`` its origin, other relative forms its folder; ``./`` and ``../`` are resolved.
    """
    raw = F.regexp_replace(F.replace(text(col), F.lit("&amp;"), F.lit("&")), rf"^['\"{SPACE}]+|['\"{SPACE}]+$", "")
    bare = F.regexp_replace(raw, "[?#].*$", "")
    root = F.regexp_replace(text(base), "[?#].*$", "") if base is not None else F.lit("")
    origin, scheme = F.regexp_extract(root, "^(https?://[^/]+)", 1), F.coalesce(F.nullif(F.regexp_extract(root, "^(https?:)", 1), F.lit("")), F.lit("https:"))
    folder = F.regexp_extract(F.when(root.rlike("^https?://[^/]+$"), F.concat(root, F.lit("/"))).otherwise(root), "^(https?://.*/)", 1)
    full = (
        F.when((bare == "") | raw.rlike("(?i)^(data|javascript|mailto):"), "")
        .when(bare.rlike("(?i)^https?://"), bare)
        .when(bare.startswith("//"), F.concat(scheme, bare))
        .when(origin == "", "")
        .when(bare.startswith("/"), F.concat(origin, bare))
        .otherwise(F.concat(folder, bare))
    )
    full = F.when(full.rlike(r"/\.\.?(/|$)"), _without_dots(full)).otherwise(full)
    host, path = F.regexp_extract(full, "(?i)^(https?://[^/]+)(.*)$", 1), F.regexp_extract(full, "(?i)^(https?://[^/]+)(.*)$", 2)
    return F.when(host == "", "").otherwise(F.concat(F.lower(host), F.when(path == "", "/").otherwise(F.regexp_replace(path, "/{2,}", "/"))))


def host(col: Column) -> Column:
    """Lower-case host without port and user; empty if there is none."""
    return F.lower(F.regexp_extract(text(col), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def in_domains(col: Column, domains: Sequence[str]) -> Column:
    """Whether the host is a domain of the list or below one."""
    name, found = host(col), F.lit(False)
    for d in domains:
        found = found | (name == d) | name.endswith("." + d)
    return found


def id_from_url(col: Column, pattern: str) -> Column:
    """First group of ``pattern``, null if it doesn't fit."""
    return F.nullif(F.regexp_extract(text(col), pattern, 1), F.lit(""))


def asset_url_from_profile(col: Column, pattern: str, before: str, after: str) -> Column:
    """``before`` + id + ``after`` for profile URLs that fit ``pattern``; else null."""
    return F.concat(F.lit(before), id_from_url(col, pattern), F.lit(after))


def srcset_last(col: Column) -> Column:
    """Last URL of a srcset; empty if there is none."""
    parts = F.filter(F.transform(F.split(squeezed(col), ","), lambda x: F.regexp_extract(trimmed(x), "^([^ ]*)", 1)), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def pick_src(*plain: Column, sets: Sequence[Column] = (), base: Column | None = None) -> Column:
    """First attribute that gives a usable URL: plain attributes, then srcsets' last URLs."""
    urls = [F.nullif(normalize_url(c, base), F.lit("")) for c in [*plain, *(srcset_last(s) for s in sets)]]
    return F.coalesce(*urls, F.lit(""))


def is_bad_asset(col: Column, pattern: str = BAD_ASSET) -> Column:
    low = F.lower(text(col))
    return (low == "") | low.rlike(pattern)


def block_reason(col: Column, reasons: Sequence[tuple[str, str]] = BLOCK_REASONS) -> Column:
    low, out = F.lower(text(col)), F.when(text(col) == "", "")
    for pattern, name in reasons:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("")


def score_asset(col: Column, weights: Sequence[tuple[str, int]] = ASSET_WEIGHTS) -> Column:
    """Sum of the weights of fitting patterns, + 100 if empty, + 50 if bad."""
    low = F.lower(text(col))
    score = F.when(low == "", 100).otherwise(0) + F.when(is_bad_asset(col), 50).otherwise(0)
    for pattern, weight in weights:
        score = score + F.when(low.rlike(pattern), weight).otherwise(0)
    return score


def in_text(hay: Column, needle: Column) -> Column:
    return (needle != "") & F.contains(hay, needle)


def score_candidate(table: str, url: Column, alt: Column | None = None, name: Column | None = None, page: Column | None = None, hint: Column | None = None) -> Column:
    """Score of an asset that stands on a page, by one of the weight tables ``search``, ``roster`` and ``photo``.

    ``search`` and ``roster`` refuse what is no absolute URL (-100), no known kind of image (-15, -10) and, for a
    search, what looks like anything but a person (-60); both like the person's name in the URL or the alternative
    text, a search also its first half. ``photo`` only weighs words of all fields together.
    """
    fields = {"url": text(url), **{k: text(c) if c is not None else F.lit("") for k, c in (("alt", alt), ("page", page), ("hint", hint))}}
    fields["all"] = F.concat_ws(" ", fields["url"], fields["alt"], fields["hint"])
    weights = {"search": rules.SEARCH_WEIGHTS, "roster": rules.ROSTER_WEIGHTS, "photo": rules.PHOTO_WEIGHTS}[table]
    score = F.lit(0)
    for field, pattern, weight in weights:
        score = score + F.when(F.lower(fields[field]).rlike(pattern), weight).otherwise(0)
    if table == "photo":
        return score
    plain = compact_name(name) if name is not None else F.lit("")
    shown = F.coalesce(F.try_url_decode(F.replace(fields["url"], F.lit("+"), F.lit("%2B"))), fields["url"])
    image, absolute = F.lower(fields["url"]).rlike(r"\.(jpg|jpeg|png|webp)(\?|$)"), fields["url"].rlike("(?i)^https?://")
    if table == "roster":
        score = score + F.when(in_text(shown, plain) | in_text(fields["alt"], plain), 3).otherwise(0)
        return F.when(~absolute, -100).when(~image, -10).otherwise(score)
    hay = F.regexp_replace(F.concat_ws(" ", shown, fields["alt"]), r"[\s\-_]", "")
    family = F.when(plain.rlike("[ァ-ヶ一-龯々]"), F.substring(plain, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(plain) / 2).cast("int")))).otherwise("")
    score = score + F.when(in_text(hay, plain), 6).otherwise(0) + F.when(in_text(hay, family), 2).otherwise(0)
    bad = F.lower(F.concat_ws(" ", fields["url"], fields["alt"])).rlike(rules.SEARCH_BAD)
    return F.when(~absolute, -100).when(bad, -60).when(~image & ~F.lower(fields["url"]).contains("special:filepath"), -15).otherwise(score)
