"""Secret scans: candidate strings, and a random forest that removes false positives, all in Spark SQL and Spark ML.

Candidates are long runs of key characters. The forest sees their length, how likely their character transitions are in
secrets and in other findings, how much of them dictionary words cover, the parts of their path and the words next to
them on both sides; it is trained from labelled findings, a table apart from these features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, release, stored

#: A candidate, with up to 48 characters on both sides; Java's quantifiers are possessive so that long runs stay linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+"
CONTEXT = 48
#: Labelled findings of each label that fitting reads, about, at most, chosen by hash.
FIT_FINDINGS = 20_000
#: Words of the dictionary, at most, and their letters at least.
WORDS, LETTERS = 400, 3
#: Symbols of transitions: letters without case, digits as 0, ``/`` as ``+`` and ``_`` as ``-``.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0+-"
#: Buckets that the last part of a path and the words before and after a candidate are hashed to.
PATHS, BEFORE, AFTER = 8, 12, 12
TREES, DEPTH, SEED = 30, 6, 11
THRESHOLD = 0.5
#: Words that announce a secret where findings are labelled by default (fixed values).
KEY_WORDS = ("api_key", "apikey", "auth", "key", "passwd", "password", "pwd", "secret", "token")
FEATURES = ("length", "switches", "transitions", "coverage", "path_depth", *(f"{k}_{i}" for k, n in (("path", PATHS), ("before", BEFORE), ("after", AFTER)) for i in range(n)))


@dataclass
class Knowledge:
    """What features need from labelled findings: dictionary words and a log-odds for each pair of symbols."""

    words: list[str]
    transitions: list[float]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id``, ``path``, ``start`` (code points), ``value``, ``before``, ``after`` of every candidate of every whole text.

    Places are found by splitting the text at candidates: a part between candidates gives the next one's offset.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), (docs[path_col].cast("string") if path_col else F.lit(None).cast("string")).alias("path"), docs[text_col].alias("text"))
    found = base.filter(F.col("text").rlike(CANDIDATE)).withColumns({"values": F.expr(f"regexp_extract_all(text, r'{CANDIDATE}', 0)"), "gaps": F.split("text", CANDIDATE, -1)})
    ends = F.transform(F.slice("gaps", 2, F.size("values")), lambda g: F.substring(g, 1, CONTEXT))
    parts = F.arrays_zip(F.col("values").alias("value"), F.slice("gaps", 1, F.size("values")).alias("gap"), ends.alias("after"))
    sizes = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("g"), F.length(p["value"]).alias("v")))
    starts = F.aggregate(sizes, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end")), lambda a, s: F.struct(F.concat(a["at"], F.array(a["end"] + s["g"])).alias("at"), (a["end"] + s["g"] + s["v"]).alias("end")))["at"]
    rows = found.select("doc_id", "path", F.explode(F.arrays_zip(parts.alias("part"), starts.alias("start"))).alias("c"))
    return rows.select("doc_id", "path", F.col("c.start").cast("long").alias("start"), F.col("c.part.value").alias("value"), F.expr(f"right(c.part.gap, {CONTEXT})").alias("before"), F.col("c.part.after").alias("after"))


def _pairs(value: Column) -> Column:
    """Numbers of the pairs of neighbouring symbols of a value."""
    plain = F.translate(F.lower(value), "123456789/_", "000000000+-")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * len(SYMBOLS) + b)


def _one_of(words: Sequence[str]) -> str:
    """A pattern of all the words, by first letter, longest first: few alternatives are tried at a place."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))


def features(found: DataFrame, known: Knowledge) -> DataFrame:
    """``found`` with one column for each of ``FEATURES``."""
    value, size = F.col("value"), F.length("value").cast("double")
    kinds = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A" * 26 + "a" * 26 + "0" * 10 + "++++")
    pairs, odds = _pairs(value), F.array(*map(F.lit, known.transitions))
    uncovered = F.length(F.regexp_replace(F.lower(value), _one_of(known.words), "")) if known.words else F.length("value")
    path = F.split(F.lower(F.coalesce("path", F.lit(""))), r"[/._-]")
    before = F.regexp_extract(F.lower(F.coalesce("before", F.lit(""))), r"([\p{L}_]+)[^\p{L}_]*$", 1)
    after = F.regexp_extract(F.lower(F.coalesce("after", F.lit(""))), r"^[^\p{L}_]*([\p{L}_]+)", 1)
    columns = {
        "length": F.least(size, F.lit(200.0)),
        "switches": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / size,
        "transitions": F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(odds, p)) / F.size(pairs),
        "coverage": 1 - uncovered / size,
        "path_depth": F.size(path),
    }
    for name, word, n in (("path", F.element_at(path, -1), PATHS), ("before", before, BEFORE), ("after", after, AFTER)):
        columns |= {f"{name}_{i}": (word != "") & (F.pmod(F.xxhash64(word), F.lit(n)) == i) for i in range(n)}
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def learnt(findings: DataFrame) -> Knowledge:
    """Dictionary and transitions of labelled findings: at most ``WORDS`` words and a number for each pair of symbols."""
    around = F.split(F.regexp_replace(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+", " "), " ")
    counted = findings.select(F.explode(around).alias("w")).filter(F.length("w") >= LETTERS).groupBy("w").count()
    words = [r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(WORDS).collect()]
    pairs = findings.select("secret", F.explode(_pairs(F.col("value"))).alias("p")).groupBy("p").agg(F.count_if("secret").alias("n1"), F.count_if(~F.col("secret")).alias("n0")).collect()
    whole, total = {r["p"]: (r["n0"], r["n1"]) for r in pairs}, [sum(r[f"n{k}"] for r in pairs) + len(SYMBOLS) ** 2 for k in (0, 1)]
    odds = [math.log((n1 + 1) / total[1]) - math.log((n0 + 1) / total[0]) for n0, n1 in (whole.get(p, (0, 0)) for p in range(len(SYMBOLS) ** 2))]
    return Knowledge(words, odds)


def fit(findings: DataFrame, sample: int = FIT_FINDINGS) -> tuple[RandomForestClassificationModel, Knowledge] | None:
    """Forest and its knowledge from labelled findings (columns of ``candidates`` and ``secret`` boolean).

    About ``sample`` findings of each label are read at most, chosen by hash. Without both labels there is none.
    """
    labelled, key = findings.filter("value is not null and secret is not null"), F.xxhash64("value", "before")
    few = stored(hash_sample(labelled.filter("secret"), key, sample).union(hash_sample(labelled.filter("not secret"), key, sample)), "findings")
    if few.select("secret").distinct().count() < 2:
        return None
    known = learnt(few)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(few, known).withColumn("label", F.col("secret").cast("double")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready.select("features", "label"))
    release(few)
    return forest, known


def labelled_findings(found: DataFrame) -> DataFrame:
    """Candidates as labelled findings, where nobody has labelled any: a quoted value with digits and letters that is
    assigned to a key word is a secret; mere letters and mere digits are none; the others have no label.

    The forest doesn't see the assignment and the quotes that label, so it judges values wherever they stand.
    """
    before = F.lower(F.coalesce("before", F.lit("")))
    sure = before.rlike("(" + "|".join(KEY_WORDS) + r")\s*[=:]\s*[\"']$") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    never = F.col("value").rlike("^[A-Za-z]+$|^[0-9]+$")
    return found.withColumn("secret", F.when(sure, True).when(never, False))


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``value``, ``probability`` double, ``secret`` boolean of every candidate.

    ``findings`` are labelled candidates to train on; by default the corpus's own, as ``labelled_findings`` labels them.
    Without findings of both labels nothing is judged: probability 0, not secret. Null and empty texts have no
    candidates; a null id or path stays null; repeated rows repeat; an empty table gives no rows; other columns aren't
    read. Texts are read whole, of any length.
    """
    found = stored(candidates(docs, id_col, text_col, path_col), "candidates")
    made = fit(labelled_findings(found) if findings is None else findings)
    if made is None:
        scored = found.withColumn("probability", F.lit(0.0))
    else:
        judged = made[0].transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found, made[1])))
        scored = judged.withColumn("probability", vector_to_array("probability")[1])
    end = F.col("start") + F.length("value")
    return scored.select("doc_id", "start", end.alias("end"), "value", F.round("probability", 9).alias("probability"), (F.col("probability") >= THRESHOLD).alias("secret"))
