"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to k errors (insertions, deletions, substitutions). Cut into k + 1 pieces, at least
one piece must stand in the text unchanged. All pieces are searched at once; around each hit Myers' bit-parallel
algorithm measures the least edit distance of the whole item to any passage.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged, stored

#: Errors allowed, as a share of the item's normalised characters.
ERROR_RATE = 0.05
#: Characters of items searched in one pass; more items take more passes.
PASS_CHARS = 4_000_000

_GAPS = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    """Lower case; every run of other characters than letters and digits is one space."""
    return _GAPS.sub(" ", text.lower()).strip() if text else ""


def distance(pattern: str, text: str, masks: dict[str, int] | None = None) -> int:
    """Least edit distance of ``pattern`` to any passage of ``text`` (Myers 1999; Python's integers hold any length)."""
    m = len(pattern)
    if masks is None:
        masks = letter_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, now = full, 0, m
    least = m
    for char in text:
        eq = masks.get(char, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            now += 1
        elif hn & top:
            now -= 1
            least = min(least, now)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(xv | hp) & full, hp & xv
    return least


def letter_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, char in enumerate(pattern):
        out[char] = out.get(char, 0) | 1 << i
    return out


class Finder:
    """Finds items in texts, of any length by one rule: with the spaces around them, and the errors that their length allows."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.tree, at = [], ahocorasick.Automaton(), {}
        for item_id, text in items:
            budget, text, number = int(rate * len(text)), f" {text} ", len(self.items)
            self.items.append((item_id, text, budget, letter_masks(text)))
            for i in range(budget + 1):
                a, b = i * len(text) // (budget + 1), (i + 1) * len(text) // (budget + 1)
                at.setdefault(text[a:b], []).append((number, a))
        for piece, places in at.items():
            self.tree.add_word(piece, (len(piece), places))
        self.tree.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least errors) of each item found, in order of id."""
        text = normalised(text)
        if not text or not self.items:
            return []
        text = f" {text} "
        windows: dict[int, list[list[int]]] = {}
        out: dict[int, int] = {}
        for end, (length, places) in self.tree.iter(text):
            for number, offset in places:
                item_id, item, budget, _ = self.items[number]
                if not budget:  # its one piece is all of it
                    out[item_id] = 0
                    continue
                size = len(item)
                start = end + 1 - length - offset
                a, b = max(0, start - budget), start + size + budget
                found = windows.setdefault(number, [])
                if found and a <= found[-1][1] and found[-1][0] <= b:
                    found[-1][0], found[-1][1] = min(a, found[-1][0]), max(b, found[-1][1])
                else:
                    found.append([a, b])
        for number, found in windows.items():
            item_id, item, budget, masks = self.items[number]
            for a, b in found:
                if out.get(item_id, budget + 1) > 0 and (errors := distance(item, text[a:b], masks)) <= budget:
                    out[item_id] = min(errors, out.get(item_id, errors))
        return sorted(out.items())


def item_passes(items: DataFrame, item_id: str, item_text: str, pass_chars: int) -> list[list[tuple[int, str]]]:
    """Normalised items in passes of about ``pass_chars`` characters each; each pass is gathered for itself."""
    pairs = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("text")).filter("item_id is not null and text is not null").distinct()
    total = pairs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = total // pass_chars + 1
    for k in range(passes):
        rows = pairs.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).toLocalIterator()
        kept = [(r.item_id, t) for r in rows if (t := normalised(r.text))]
        if kept or k == 0:
            yield sorted(kept)


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """Pairs of document and test item: ``doc_id`` long, ``item_id`` long, ``errors`` long (least edit distance).

    Texts and items are compared in normalised form (see ``normalised``), whole texts always. An item is found where a
    passage has at most ``rate`` of the item's length in errors, rounded down; the spaces before and after it count as part
    of it, so an item too short for an error stands as whole words. Null or empty texts and items (also of mere marks) match nothing; items without id are skipped; a null doc_id comes back null.
    Repeated rows give one pair, with the least errors. Empty tables give no rows. Other columns aren't read.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = None
    for part in item_passes(items, item_id, item_text, pass_chars):

        def make(part=part):
            finder = Finder(part, rate)
            return lambda texts: [(finder.find(t),) for t in texts]

        # an array column keeps the batch one to one with the documents
        one = judged(base, ["doc_id", "text"], make, "hits array<struct<item_id:long,errors:long>>").select("doc_id", F.explode("hits").alias("hit"))
        found = one if found is None else found.union(one)
    return found.groupBy("doc_id", F.col("hit.item_id").alias("item_id")).agg(F.min("hit.errors").alias("errors"))


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns stay, row by row, with no join."""
    names = [c for c in docs.columns if c != text_col]
    kept = docs
    for part in item_passes(items, "item_id", "text", pass_chars):

        def make(part=part):
            finder = Finder(part, rate)
            return lambda texts: [(bool(finder.find(t)),) for t in texts]

        kept = judged(kept, [*(f"`{n}`" for n in names), f"`{text_col}`"], make, "__leak boolean").filter("not __leak").drop("__leak")
    return kept.select(*(f"`{c}`" for c in docs.columns))
