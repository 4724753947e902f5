"""Stored pages: links, images, blocks, tables, JSON trees, lines and records of lines; scoring of parses."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairan.functions.text import compact_name, html_text, present, squeezed
from kairan.functions.urls import normalize_url


#: A condition on a line.
Test = Callable[[Column], Column]
#: The rest of a tag up to its end: a ``>`` within quotes doesn't end it.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>]++)"""


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of a name: in quotes of either kind or bare; empty if it isn't there.

    Attributes are gone through in order, so that what stands within another one's quotes isn't taken for one.
    """
    other = rf"""(?:[\s/]++(?!{name}\s*=)[^\s=>/"']++(?:\s*+=\s*+{_VALUE.replace("(", "(?:", 1)})?+)*+"""
    raw = F.regexp_extract(tag, rf"(?is)^<[a-z][a-z0-9]*+{other}[\s/]++{name}\s*=\s*{_VALUE}", 1)
    quoted = raw.startswith('"') | raw.startswith("'")
    return F.coalesce(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw), F.lit(""))


def extract_links(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``page_id``, ``ord``, ``href``, ``text``, ``absolute`` of anchors; ``path`` keeps those whose URL matches."""
    start = rf"(?is)<a\s{_REST}"
    tags = F.regexp_extract_all(without_comments(F.col("html")), F.lit(rf"{start}.*?</a>"), F.lit(0))
    # read within the array, so that later expressions see columns and don't repeat the patterns
    read = F.transform(tags, lambda tag: F.struct(attribute(tag, "href").alias("href"), html_text(F.regexp_replace(tag, rf"^{start}", "")).alias("text")))
    out = pages.select("page_id", "url", F.posexplode(read).alias("ord", "a")).select("page_id", "ord", "a.href", "a.text", "url").filter("href <> ''")
    out = out.select("page_id", "ord", "href", "text", normalize_url(F.col("href"), F.col("url")).alias("absolute"))
    return out.filter(F.col("absolute").rlike(path)) if path else out


def extract_images(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``page_id``, ``ord``, ``src``, ``data_src``, ``srcset``, ``alt`` of images; ``path`` keeps those whose URL matches."""
    tags = F.regexp_extract_all(without_comments(F.col("html")), F.lit(rf"(?is)<img(?=[\s/>]){_REST}"), F.lit(0))
    read = F.transform(tags, lambda tag: F.struct(*(attribute(tag, n).alias(n.replace("-", "_")) for n in ("src", "data-src", "srcset", "alt"))))
    out = pages.select("page_id", F.posexplode(read).alias("ord", "i")).select("page_id", "ord", "i.*")
    return out.filter(F.concat("src", F.lit(" "), "data_src").rlike(path)) if path else out


class _Images(HTMLParser):
    """Images of a page in the order in which they count: those of meta tags, then img tags' sources with their surroundings."""

    #: Elements without an end tag, and characters of its parent's text that stand for an image's surroundings.
    VOID, AROUND = frozenset("area base br col embed hr img input link meta source track wbr".split()), 120
    META = (("property", "og:image"), ("name", "og:image"), ("name", "twitter:image"), ("property", "twitter:image"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: list[tuple[int, str]] = []
        self.found: list[tuple[list[str], str, str, list]] = []
        self.open: list[tuple[str, list]] = [("", [0, []])]  # tag; length and pieces of its text so far

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        if tag == "meta":
            self.meta += [(n, own.get("content", "")) for n, (k, v) in enumerate(self.META) if own.get(k) == v]
        elif tag == "img" and {"src", "data-src", "data-lazy-src"} & own.keys():
            first = own.get("srcset", "").split(",")[0].split()
            sources = [own.get(n, "") for n in ("src", "data-src", "data-lazy-src")] + first[:1]
            alt = " ".join((own.get("alt") or own.get("title", "")).split())
            self.found.append((sources, alt, " ".join(own.get("class", "").split()), self.open[-1][1]))
        if tag not in self.VOID:
            self.open.append((tag, [0, []]))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        words = len("".join(data.split()))
        for _, text in self.open[-64:]:
            if text[0] < self.AROUND:
                text[0] += words
                text[1].append(data)

    def rows(self) -> Iterator[tuple[str, str, str]]:
        """Source, alternative text and hint of each, in order."""
        for _, content in sorted(self.meta, key=lambda x: x[0]):
            yield content, "", "meta"
        for sources, alt, classes, (_, pieces) in self.found:
            hint = f"{classes} {' '.join(''.join(pieces).split())[: self.AROUND]}"
            for source in sources:
                yield source, alt, hint


def collect_images(pages: DataFrame) -> DataFrame:
    """``page_id``, ``ord``, ``src``, ``alt``, ``hint`` of all that may be a page's images.

    First meta tags' (hint ``meta``), then each img tag's ``src``, ``data-src``, ``data-lazy-src`` and first of its
    ``srcset``; their hint is the tag's classes and the first 120 characters of its parent's text. Quotes of both kinds,
    bare values, ``>`` within values, comments and unclosed elements are read as browsers do.
    """
    kind = T.StructType([pages.schema["page_id"], *T.StructType.fromDDL("ord int, src string, alt string, hint string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, html in enumerate(batch.column(1)):
                parser = _Images()
                parser.feed(html.as_py() or "")
                parser.close()
                own = [(n, *x) for n, x in enumerate(parser.rows()) if x[0].strip()]
                at += [i] * len(own)
                rows += own
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", "ord", "src", "alt", "hint"])

    return pages.select("page_id", "html").mapInArrow(run, kind)


def extract_blocks(pages: DataFrame, block: str, fields: Mapping[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """One row a repeated block: group 1 of each field's pattern as plain text; rows that lack a required field go."""
    out = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("ord", "block"))
    out = out.select("page_id", "ord", *(html_text(F.regexp_extract("block", p, 1)).alias(n) for n, p in fields.items()))
    for r in required:
        out = out.filter(F.col(r) != "")
    return out


class _Tables(HTMLParser):
    """Rows of cells of all tables, nested ones too; a nested table's text is not its outer cell's."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([[], None, None])
        elif self.open and tag == "tr":
            self.open[-1][1] = []
            self.open[-1][0].append(self.open[-1][1])
        elif self.open and tag in ("td", "th") and self.open[-1][1] is not None:
            self.open[-1][2] = []
            self.open[-1][1].append(self.open[-1][2])

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th"):
            self.open[-1][2] = None
        elif tag == "table":
            rows = self.open.pop()[0]
            self.tables.append([[" ".join("".join(c).split()) for c in r] for r in rows])

    def handle_data(self, data):
        if self.open and self.open[-1][2] is not None:
            self.open[-1][2].append(data)


def extract_table(pages: DataFrame, header: list[str]) -> DataFrame:
    """``page_id``, ``table``, ``ord``, ``cells``: rows under a header row of exactly these labels, with as many cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Tables()
                parser.feed(html or "")
                for n, rows in enumerate(parser.tables):
                    if header in rows:
                        out += [(page, n, i, r) for i, r in enumerate(rows[rows.index(header) + 1 :]) if len(r) == len(header)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "table", "ord", "cells"])

    return pages.select(F.col("page_id").cast("long"), "html").filter(F.lower("html").contains("<table")).mapInArrow(run, "page_id long, table int, ord int, cells array<string>")


def walk_json(docs: DataFrame, image: str = r"^https?://.*\.(?:jpg|jpeg|png|webp)") -> DataFrame:
    """``doc_id``, ``ord``, ``text``, ``image``, ``width``, ``height`` of every object with string values, of any depth."""
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(image, re.I)
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    todo, ord_ = [json.loads(body or "null")], 0
                except ValueError:
                    continue
                while todo:
                    node = todo.pop()
                    if isinstance(node, list):
                        todo += reversed(node)
                    elif isinstance(node, dict):
                        strings = [v for v in node.values() if isinstance(v, str)]
                        if strings:
                            size = [int(v) if isinstance(v := node.get(k), int | float) and not isinstance(v, bool) else None for k in ("width", "height")]
                            out.append((doc, ord_, " ".join(strings), next((s for s in strings if pattern.search(s)), None), *size))
                            ord_ += 1
                        todo += reversed([v for v in node.values() if isinstance(v, dict | list)])
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "ord", "text", "image", "width", "height"])

    return docs.select(F.col("doc_id").cast("long"), "json").mapInArrow(run, "doc_id long, ord int, text string, image string, width long, height long")


def text_lines(pages: DataFrame, col: str = "text") -> DataFrame:
    """``page_id``, ``pos``, ``line``: squeezed non-blank lines in order."""
    return pages.select("page_id", F.posexplode(F.split(col, "\n")).alias("pos", "raw")).select("page_id", "pos", squeezed(F.col("raw")).alias("line")).filter("line <> ''")


def parse_role_lines(lines: DataFrame, pattern: str = r"^(.+?(?:委員長|会長))\s+(.+)$") -> DataFrame:
    """``role`` and ``name`` of lines that hold both."""
    return lines.filter(F.col("line").rlike(pattern)).select("page_id", "pos", F.regexp_extract("line", pattern, 1).alias("role"), F.regexp_extract("line", pattern, 2).alias("name"))


def group_lines(lines: DataFrame, is_name: Column, is_suffix: Column | None = None, is_noise: Column | None = None, is_end: Column | None = None) -> DataFrame:
    """Records of lines: role lines up to a name line close one; the suffix line right behind is attached to it.

    ``page_id``, ``record``, ``name``, ``roles`` (distinct, in order), ``suffix``. Noise lines don't count; the first
    end line ends a page; role lines after the last name give no record. A page is one document's lines.
    """
    false = F.lit(False)
    kept = lines if is_noise is None else lines.filter(~is_noise)
    page = Window.partitionBy("page_id").orderBy("pos")
    if is_end is not None:
        kept = kept.withColumn("_ended", F.max(is_end.cast("int")).over(page)).filter("_ended = 0")
    suffix = is_suffix if is_suffix is not None else false
    kind = F.when(is_name, "name").when(suffix, "suffix").otherwise("role")
    marked = kept.withColumn("_kind", kind)
    before = F.coalesce(F.sum((F.col("_kind") == "name").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a suffix line belongs to the record before it
    placed = marked.withColumn("record", F.when(F.col("_kind") == "suffix", before - 1).otherwise(before)).filter("record >= 0")
    first = lambda k: F.min_by(F.when(F.col("_kind") == k, F.col("line")), F.when(F.col("_kind") == k, F.col("pos")))
    roles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == "role", F.struct("pos", "line")))), lambda x: F.regexp_replace(x["line"], r"^・\s*", "")))
    return placed.groupBy("page_id", "record").agg(first("name").alias("name"), roles.alias("roles"), first("suffix").alias("suffix")).filter("name is not null")


def page_records(pages: DataFrame, is_name: Test, is_suffix: Test | None = None, is_noise: Test | None = None, is_end: Test | None = None, col: str = "text") -> DataFrame:
    """The records of ``group_lines`` for pages whose lines stand in one column: found within each row, without a shuffle.

    Each test is a function of a line. A page without a name line is left at once; records are slices between the
    places of name lines, so a page takes time linear in its lines.
    """
    lines = F.filter(F.transform(F.split(F.col(col), "\n"), squeezed), lambda x: (x != "") & ~(is_noise(x) if is_noise else F.lit(False)))
    rows = pages.select("page_id", lines.alias("_lines"))
    if is_end:
        end = F.array_position(F.transform("_lines", is_end), True)
        rows = rows.select("page_id", F.when(end > 0, F.slice("_lines", F.lit(1), (end - 1).cast("int"))).otherwise(F.col("_lines")).alias("_lines"))
    rows = rows.filter(F.exists("_lines", is_name))
    rows = rows.select("page_id", "_lines", F.filter(F.transform("_lines", lambda x, i: F.when(is_name(x), i)), lambda i: i.isNotNull()).alias("_at"))
    suffix = is_suffix or (lambda x: F.lit(False))

    def record(p: Column, k: Column) -> Column:
        before = F.when(k == 0, -1).otherwise(F.col("_at")[k - 1])
        roles = F.filter(F.slice("_lines", before + 2, p - before - 1), lambda x: ~suffix(x))
        behind = F.slice("_lines", p + 2, F.coalesce(F.get("_at", k + 1), F.size("_lines")) - p - 1)
        bare = F.array_distinct(F.transform(roles, lambda x: F.regexp_replace(x, r"^・\s*", "")))
        return F.struct(k.cast("long").alias("record"), F.col("_lines")[p].alias("name"), bare.alias("roles"), F.get(F.filter(behind, suffix), F.lit(0)).alias("suffix"))

    return rows.select("page_id", F.inline(F.transform("_at", record)))


def score_entry_sets(df: DataFrame, keywords: list[str], set_col: str = "tag") -> DataFrame:
    """Score and size of each parse (``tag``) of rows with name, kana, sub_role, chamber."""
    name, role = squeezed(F.col("name")), squeezed(F.col("sub_role"))
    key = F.nullif(compact_name(F.col("name")), F.lit(""))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | role.contains(k)
    points = F.when(name != "", 3).otherwise(0) + F.when(present(F.col("kana")).isNotNull(), 1).otherwise(0) + F.when(name.rlike(r"^[一-龯々ぁ-んァ-ヶー・ ]+$"), 3).otherwise(0) + F.when(hit, 4).otherwise(0) + F.when(F.col("chamber").isin("衆議院", "参議院"), 2).otherwise(0)
    n, names, roles = F.count("*"), F.countDistinct(key), F.countDistinct(F.nullif(role, F.lit("")))
    return df.groupBy(set_col).agg(n.alias("n"), (n * 10 + roles * 2 - (n - names) * 15 + F.sum(points)).alias("score"))


def best_set(df: DataFrame, scores: DataFrame, label: str | None = None, set_col: str = "tag") -> DataFrame:
    """Rows of the parse with the highest score, then size (per ``label``, if given)."""
    by = [F.desc("score"), F.desc("n"), F.col(set_col).asc()]
    if label is None:
        return df.join(F.broadcast(scores.orderBy(*by).limit(1).select(set_col)), set_col, "left_semi")
    best = scores.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(*by))).filter("_n = 1")
    return df.join(best.select(label, set_col), [label, set_col], "left_semi")


def decode_best(files: DataFrame, tokens: list[str], charsets: tuple[str, ...] = ("utf-8", "shift_jis", "euc-jp")) -> DataFrame:
    """``path``, ``charset``, ``text`` of binary ``content``: most expected tokens, less 10 with replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tried = [(c, (raw or b"").decode(c, "replace")) for c in charsets]
                out.append((path, *max(tried, key=lambda x: sum(t in x[1] for t in tokens) - 10 * ("�" in x[1]))))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "charset", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, charset string, text string")
