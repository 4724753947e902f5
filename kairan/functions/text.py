"""Text functions on Columns: keys, names, scripts, dates, markup. All but ``nfkc`` are Spark built-ins."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Unicode white space as a character class's content; Java's ``\s`` and Spark's ``trim`` are ASCII only.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: The same characters, one after the other.
SPACES = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Old and new forms of name characters; every form of a group maps to one representative.
VARIANT_PAIRS = (("髙", "高"), ("﨑", "崎"), ("邊", "辺"), ("邉", "辺"), ("齊", "斉"), ("齋", "斎"), ("澤", "沢"), ("廣", "広"), ("德", "徳"), ("濵", "浜"), ("濱", "浜"), ("嶋", "島"), ("桒", "桑"), ("冨", "富"), ("榮", "栄"))

# Words that are no part of a name.
NAME_NOISE = "衆院選|衆議院|開票結果|候補者|プロフィール|読売新聞|オンライン|選挙区|比例|当選|年齢|党派|経歴|学歴|出身地|自民党|公明党|立憲民主党|日本維新の会|国民民主党|参政党|日本共産党"
# The blocks of proportional representation.
BLOCKS = "北海道|東北|北関東|南関東|東京|北陸信越|東海|近畿|中国|四国|九州"

# Prefectures from north to south.
REGION_ORDER = ("北海道", "青森", "岩手", "宮城", "秋田", "山形", "福島", "茨城", "栃木", "群馬", "埼玉", "千葉", "東京", "神奈川", "新潟", "富山", "石川", "福井", "山梨", "長野", "岐阜", "静岡", "愛知", "三重", "滋賀", "京都", "大阪", "兵庫", "奈良", "和歌山", "鳥取", "島根", "岡山", "広島", "山口", "徳島", "香川", "愛媛", "高知", "福岡", "佐賀", "長崎", "熊本", "大分", "宮崎", "鹿児島", "沖縄")

# Short forms of role phrases, applied in order.
ROLE_SHORT = (("内閣総理大臣", "総理"), ("内閣官房長官", "官房長官"), ("文部科学", "文科"), ("厚生労働", "厚労"), ("農林水産", "農水"), ("経済産業", "経産"), ("国土交通", "国交"), ("沖縄及び北方問題に関する", "沖縄北方"), ("消費者問題に関する", "消費者"), ("政治倫理の確立及び公職選挙法改正に関する", "政治倫理"), ("大臣政務官", "政務官"))


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no function for it."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def text(col: Column) -> Column:
    """Null becomes empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def trimmed(col: Column) -> Column:
    """Without outer Unicode white space; null becomes empty."""
    return F.btrim(text(col), F.lit(SPACES))


def present(col: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(trimmed(col), F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*(present(c) for c in cols))


def squeezed(col: Column) -> Column:
    return F.btrim(F.regexp_replace(text(col), f"(?![!-~])[{SPACE}]+", " "), F.lit(" "))  # most characters are told at once


def compact(col: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(col), f"[{SPACE}]+", "")


def plain_name(col: Column) -> Column:
    """Without parenthesised parts and a final honorific."""
    return trimmed(F.regexp_replace(F.regexp_replace(squeezed(col), r"[（(][^）)]*[）)]", ""), "君$", ""))


def compact_name(col: Column) -> Column:
    """Without parenthesised parts and white space."""
    return compact(F.regexp_replace(squeezed(col), r"[（(][^）)]*[）)]", ""))


def match_key(col: Column) -> Column:
    """Without half- and full-width spaces, parenthesised text, dashes and long-vowel marks."""
    bare = F.regexp_replace(F.regexp_replace(text(col), "[ 　]", ""), r"（.*?）|\(.*?\)", "")
    return trimmed(F.regexp_replace(bare, r"[‐‑‒–—―ーｰ\-]", ""))


def nfkc_key(col: Column) -> Column:
    """NFKC, without spaces, bracket characters, middle dots, dashes and a final honorific."""
    return F.regexp_replace(F.regexp_replace(nfkc(text(col)), rf"[{SPACE}()（）\[\]【】「」『』・･‐‑‒–—―ーｰ\-]", ""), "君$", "")


def to_halfwidth(col: Column) -> Column:
    """Full-width ASCII to ASCII, ideographic space to space."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(col, wide + "　", "".join(chr(ord(c) - 0xFEE0) for c in wide) + " ")


def to_hiragana(col: Column) -> Column:
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(col, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def split_name_kana(col: Column) -> Column:
    """``name（kana）`` or ``name(kana)`` as a struct of ``name`` and ``kana``."""
    base = trimmed(col)
    wide, ascii_ = r"^(.*?)（([^）]+)）$", r"^(.*?)\(([^)]+)\)$"
    part = lambda i: F.when(base.rlike(wide), F.regexp_extract(base, wide, i)).when(base.rlike(ascii_), F.regexp_extract(base, ascii_, i))
    return F.struct(trimmed(F.coalesce(part(1), base)).alias("name"), compact(F.coalesce(part(2), F.lit(""))).alias("kana"))


def variant_key(col: Column, pairs: Sequence[tuple[str, str]] = VARIANT_PAIRS) -> Column:
    """A key equal for names that differ only in old and new character forms: one representative a group."""
    group: dict[str, str] = {}
    for a, b in pairs:
        old, new = group.get(a, a), group.get(b, b)
        group.update({k: new for k, v in group.items() if v == old} | {a: new, b: new})
    swaps = {a: b for a, b in sorted(group.items()) if a != b}
    return F.translate(match_key(col), "".join(swaps), "".join(swaps.values()))


_NAME_CHARS = "一-龯々〆ヶぁ-んァ-ヶヴー"


# What is taken out around a name, in this order, and what stands there then.
NOISE_STEPS = (
    (rf"^[0-9]+[{SPACE}]*区", " "),
    (rf"^比例(?:{BLOCKS})ブロック", " "),
    (rf"^(?:{BLOCKS})比例", " "),
    ("^[区比]", " "),
    ("氏|さん|君$", ""),
    (r"（[^）]*）|\([^)]*\)|【[^】]*】|\[[^\]]*\]", " "),
    (NAME_NOISE, " "),
)


def strip_name_noise(col: Column) -> Column:
    base = squeezed(nfkc(text(col)))
    for pattern, to in NOISE_STEPS:
        base = F.regexp_replace(base, pattern, to)
    return squeezed(base)


def name_aliases(col: Column) -> Column:
    """Array of a name's aliases: the whole, the whole without kana runs, tokens and script runs of 2 to 20 characters.

    Those with kanji come first; the first is the primary alias.
    """
    raw = strip_name_noise(col)
    runs = F.regexp_extract_all(raw, F.lit(f"([{_NAME_CHARS}]{{2,20}})"), F.lit(1))
    parts = F.concat(F.array(raw, F.regexp_replace(raw, "[ぁ-んァ-ヶヴー]{2,}", " ")), F.split(raw, rf"[{SPACE}/｜|・]+"), runs)
    clean = lambda x: F.regexp_replace(to_halfwidth(x), rf"[{SPACE}・･\-－ー―‐()（）【】\[\]「」『』]", "")
    kept = F.array_distinct(F.filter(F.transform(parts, clean), lambda x: F.length(x).between(2, 20) & x.rlike(f"[{_NAME_CHARS}]")))
    kanji = F.filter(kept, lambda x: x.rlike("[一-龯々〆ヶ]"))
    return F.array_distinct(F.concat(kanji, kept))


def clean_district(col: Column) -> Column:
    base = F.regexp_replace(trimmed(col), rf"^選挙区[{SPACE}]*[：:]?[{SPACE}]*", "")
    return trimmed(F.regexp_replace(F.regexp_replace(base, r"[（(]([^）)]+)[）)]", "$1"), "選挙区", ""))


def district_rank(col: Column, order: Sequence[str] = REGION_ORDER, proportional: str = "比例") -> Column:
    """Position of the first listed region that the text holds; 9998 if none, 9999 if proportional."""
    base = clean_district(col)
    rank = F.when(base == "", 9998).when(base.contains(proportional), 9999)
    for i, region in enumerate(order):
        rank = rank.when(base.contains(region), i)
    return rank.otherwise(9998)


def expand_label(col: Column, mapping: Mapping[str, str]) -> Column:
    """Short label to full label; others pass."""
    if not mapping:
        return col
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, col), col)


def shorten_role(col: Column, rules: Sequence[tuple[str, str]] = ROLE_SHORT, dropped: Sequence[str] = ("衆議院", "参議院")) -> Column:
    """Parts between slashes without the dropped ones, with phrases shortened in order."""
    parts = F.filter(F.transform(F.split(text(col), "/"), trimmed), lambda x: (x != "") & ~x.isin(*dropped))
    out = F.array_join(parts, " / ")
    for old, new in rules:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def era_year(col: Column) -> Column:
    """``令和N年`` as 2018 + N, else a ``20YY年``, else null."""
    base = to_halfwidth(text(col))
    era, west = F.regexp_extract(base, r"令和\s*([0-9]+)\s*年", 1), F.regexp_extract(base, r"(20[0-9]{2})\s*年", 1)
    return F.when(base.rlike(r"令和\s*元年"), 2019).when(era != "", era.try_cast("int") + 2018).when(west != "", west.try_cast("int"))


def stable_id(*cols: Column) -> Column:
    """10000000 + fold of code points by (h * 131 + c) mod 90000000 over the values joined by ``:``."""
    joined = F.concat_ws(":", *(text(c) for c in cols))
    points = F.transform(F.filter(F.split(joined, ""), lambda c: c != ""), F.ascii)
    return F.aggregate(points, F.lit(0).cast("long"), lambda h, c: (h * 131 + c) % 90_000_000) + 10_000_000


def decode_entities(col: Column) -> Column:
    out = F.regexp_replace(text(col), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trimmed(out)


def html_text(col: Column) -> Column:
    """Entities decoded, tags replaced by a space, white space squeezed."""
    return squeezed(F.regexp_replace(decode_entities(col), "<[^>]+>", " "))


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
_SPACES = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), SPACE) + "]+")
_CDATA, _TAG = re.compile(r"(?s)<!\[CDATA\[(.*?)\]\]>"), re.compile("<[^>]+>")


def plain_text(html: str) -> str:
    """``html_text`` of a Python string, for tasks that cut many pieces out of one page."""
    out = _CDATA.sub(r"\1", html) if "<![CDATA[" in html else html
    for entity, char in _ENTITIES if "&" in out else ():
        out = out.replace(entity, char)
    return _SPACES.sub(" ", _TAG.sub(" ", out)).strip(" ")


# cell-shape predicates
def is_name_like(col: Column) -> Column:
    base = compact(col)
    return (base != "") & ~base.rlike("氏名|ふりがな|会派|選挙区|当選回数|議員一覧|衆議院|会派別議員一覧|[0-9]") & base.rlike("[一-龠々ヶヵぁ-んァ-ヴ]")


def is_kana_like(col: Column) -> Column:
    return compact(col).rlike("^[ぁ-んゔー・]+$")


def is_party_like(col: Column, pattern: str) -> Column:
    return compact(col).rlike(pattern)


def is_wins_like(col: Column) -> Column:
    return compact(col).rlike("^[0-9]{1,2}(?:（[^）]+）)?$")
