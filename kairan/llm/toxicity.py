"""Toxicity by maximum-scoring segments of token log-odds.

Fitting counts tokens in labelled texts and turns them into log-odds with an informative Dirichlet prior (Monroe,
Colaresi and Quinn 2008). Scoring adds the log-odds of a text's tokens; the linear-time scan of Ruzzo and Tompa (1999)
finds every maximal segment; the Karlin-Altschul extreme-value law turns each segment's sum and the text's length into
an expected number of equally good segments in clean text (the law is fitted to clean texts' best segments); the text's
evidence is calibrated to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, crc_mod, hash_sample, judged, release, stored, text_slices

#: Distinct tokens that a task counts before it passes them on.
COUNTED = 200_000
#: Labelled texts that fitting reads, about, at most, chosen by hash of their ids.
SAMPLE = 20_000
#: Tenths of them that calibrate; the others give the log-odds.
CALIBRATION = 3
#: Tokens with evidence that a model keeps, strongest first.
LEXICON = 50_000
#: A token's score is its log-odds less so many standard errors, towards 0 (the lower end of a one-sided 90 % interval):
#: what few texts say counts less. Tokens of fewer texts than this have no score.
SHRINK, LEAST_TEXTS = 1.28, 4
#: Scores below one of these aren't kept: the one under which the calibrating texts' labels are likeliest.
LEAST_SCORES = (0.0, 0.5, 1.0, 1.5)
#: Characters of the word beginnings that stand in for words too rare for evidence of their own.
STEMS = range(4, 9)
#: The Dirichlet prior's pseudo-counts, as a share of all counts: a token's prior is this share of its own count.
PRIOR = 0.1
#: A word counts less where it stands within so many tokens of its last place: so many times what it counted there, and
#: this at the least (a run of a word stays one passage).
NEAR, AGAIN, LEAST_AGAIN = 64, 0.25, 1e-9
#: A segment is a toxic passage if clean texts of this length have fewer equally good ones.
SIGNIFICANT = 0.01
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stems(word: str) -> list[str]:
    """The word's beginnings, longest first; a trailing ``*`` sets them apart from words."""
    return [word[:n] + "*" for n in reversed(STEMS) if n < len(word)]


@dataclass
class Model:
    """Token scores and calibration; bounded by ``LEXICON``."""

    scores: dict[str, float] = field(default_factory=dict)
    default: float = -0.01
    k: float = 0.1
    decay: float = 1.0
    bias: float = -3.0
    slope: float = 0.5

    def score(self, word: str) -> float:
        found = self.scores.get(word)
        if found is None:
            found = next((s for x in stems(word) if (s := self.scores.get(x)) is not None), self.default)
        return found


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), by Ruzzo and Tompa's scan; only positive values are visited.

    Each candidate knows the nearest one before it that begins lower, so the scan jumps over those between, and all of it
    takes linear time.
    """
    sums = np.concatenate([[0.0], np.cumsum(values)])
    found: list[tuple[float, float, int, int, int]] = []  # sums left and right of the segment, its place, the one to jump to
    for i in np.flatnonzero(values > 0).tolist():
        left, right, start = sums[i], sums[i + 1], i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
        found.append((left, right, start, i + 1, j))
    return [(a, b, float(r - x)) for x, r, a, b, _ in found]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, Cache(model.score)

    def values(self, words: list[str]) -> np.ndarray:
        """Each token's log-odds; a word of evidence within ``NEAR`` tokens of its last place counts ``AGAIN`` times that one.

        So a run of one word is one passage, of hardly more evidence than the word, and a later passage counts anew.
        """
        values = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        last: dict[str, tuple[int, float]] = {}
        for i in np.flatnonzero(values > 0).tolist():
            at, before = last.get(words[i], (-1 - NEAR, 0.0))
            if i - at <= NEAR:
                values[i] = max(before * AGAIN, LEAST_AGAIN)
            last[words[i]] = i, values[i]
        return values

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first token, end, sum, expected number in clean text) of each significant maximal segment, or of the best one."""
        m, found = self.model, maximal_segments(self.values(words))
        told = [(a, b, s, m.k * len(words) * math.exp(-m.decay * s)) for a, b, s in found]
        strong = [x for x in told if x[3] <= SIGNIFICANT]
        return strong if strong else [max(told, key=lambda x: (x[2], -x[0]))] if told else []

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Sum over significant segments of -log of their expected number, at the least the best segment's."""
        found = self.segments(words)
        strong = [x for x in found if x[3] <= SIGNIFICANT]
        return max(0.0, sum(-math.log(max(x[3], 1e-300)) for x in strong or found)), strong

    def probability(self, evidence: float) -> float:
        z = self.model.bias + self.model.slope * max(-5.0, min(40.0, evidence))
        return 1 / (1 + math.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows at most, chosen by hash of their ids. Rows without label or text don't count.

    Numbers of distinct texts that hold a token are added up by Spark; only tokens with evidence (``LEXICON`` at most),
    sums, and two numbers a calibrating text come to the driver.
    Without rows of both labels the model calls nothing toxic.
    """
    chosen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    chosen = hash_sample(chosen.groupBy("id").agg(F.max("y").alias("y")), F.col("id"), sample)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").select("y", "text", (F.pmod(F.xxhash64("text"), F.lit(10)) < CALIBRATION).alias("rest"))
    labelled = stored(rows.dropDuplicates(["text"]), "labelled")  # copies are no evidence of their own
    tuned, rows = labelled.filter("rest"), labelled.filter("not rest")

    def count(batches):
        counts = ({}, {})
        held = (Counter(), Counter())

        def emit():
            names = list(set(held[0]) | set(held[1]))
            out = pa.RecordBatch.from_pydict({"token": names, "n0": [held[0][x] for x in names], "n1": [held[1][x] for x in names]})
            for h in held:
                h.clear()
            return out

        for part in text_slices(batches, 1):
            for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                distinct = set(tokens(t))
                distinct.update(stem for word in list(distinct) for stem in stems(word))
                held[y].update(distinct)
                held[y][""] += len(distinct)
            if len(held[0]) + len(held[1]) > COUNTED:
                yield emit()
        if held[0] or held[1]:
            yield emit()

    counts = rows.select("y", "text").mapInArrow(count, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS)
    total = F.broadcast(counts.filter("token = ''").select(F.col("n0").alias("t0"), F.col("n1").alias("t1")))
    prior, everything = F.lit(PRIOR) * (F.col("n0") + F.col("n1")), F.lit(PRIOR) * (F.col("t0") + F.col("t1"))
    odds = lambda n, t: F.log((F.col(n) + prior) / (F.col(t) + everything - F.col(n) - prior))
    delta = odds("n1", "t1") - odds("n0", "t0")
    error = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    value = F.signum(delta) * (F.abs(delta) - SHRINK * error)
    scored = counts.crossJoin(total).filter("token <> ''").filter(F.abs(delta) - SHRINK * error > LEAST_SCORES[0]).select("token", "t0", "t1", value.alias("value"))
    strong = scored.orderBy(F.desc(F.abs("value")), "token").limit(LEXICON).toPandas()
    if not len(strong) or strong["t1"].iloc[0] == 0 or strong["t0"].iloc[0] == 0:
        return Model(bias=-20.0, slope=0.0)
    every = dict(zip(strong["token"], strong["value"].astype(float), strict=True))
    models = [Model({w: v for w, v in every.items() if abs(v) > least}) for least in LEAST_SCORES]
    models = [m for m in models if m.scores] or [Model(every)]

    def totals(batches):
        scorers = [Scorer(Model(m.scores, default=0.0)) for m in models]
        for part in text_slices(batches, 1):
            words = [tokens(t) for t in part.column(1).to_pylist()]
            hit = [[sum(s.known[w] != 0 for w in ws) for s in scorers] for ws in words]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, words), pa.int64()), pa.array(hit, pa.list_(pa.int64()))], ["y", "n", "hit"])

    # tokens without evidence are a little rarer in toxic texts, for these hold tokens with evidence
    hits = [F.sum(F.col("hit")[i]).alias(f"hit{i}") for i in range(len(models))]
    sums = {r["y"]: r for r in rows.select("y", "text").mapInArrow(totals, "y long, n long, hit array<long>").groupBy("y").agg(F.sum("n").alias("n"), *hits).collect()}
    for i, m in enumerate(models):
        plain = [(sums[y]["n"] - sums[y][f"hit{i}"] + 1) / (sums[y]["n"] + 2) for y in (0, 1)]
        m.default = min(-1e-3, math.log(plain[1] / plain[0]))

    def tell(what):
        """Label, number of tokens and what each model says, of every calibrating text."""

        def run(batches):
            scorers = [Scorer(m) for m in models]
            for part in text_slices(batches, 1):
                words = [tokens(t) for t in part.column(1).to_pylist()]
                said = [[float(what(s, ws)) for s in scorers] for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(map(len, words), pa.int64()), pa.array(said, pa.list_(pa.float64()))], ["y", "n", "said"])

        found = tuned.select("y", "text").mapInArrow(run, "y long, n long, said array<double>").toPandas()
        return found, np.array(found["said"].tolist()).reshape(len(found), len(models))

    tops, said = tell(lambda s, ws: max((x[2] for x in s.segments(ws)), default=0.0))
    clean = ((tops.y == 0) & (tops.n > 0)).to_numpy()
    for i, m in enumerate(models):
        m.decay, m.k = extreme_value(said[clean, i], tops.n.to_numpy(float)[clean])
    seen, said = tell(lambda s, ws: s.evidence(ws)[0])
    y, fits = seen.y.to_numpy().astype(float), []
    for i, m in enumerate(models):
        x = np.clip(said[:, i], -5, 40)
        m.bias, m.slope = logistic(x, y)
        z = m.bias + m.slope * x
        fits.append(float((np.logaddexp(0, z) - y * z).sum()))
    release(labelled)
    return models[int(np.argmin(fits))]


def extreme_value(tops: np.ndarray, sizes: np.ndarray, floor: float = 1.0) -> tuple[float, float]:
    """Decay and k of the law P(best sum > x) = 1 - exp(-k n exp(-decay x)), by maximum likelihood over clean texts.

    A text whose best sum is at most ``floor`` only says that there was nothing beyond. For each decay the best k is
    known in closed form; decays are tried on a grid. Without a text the law is that of one such sum in 1000 tokens.
    """
    if not len(tops):
        return 1.0, 1e-3
    found, beyond = (-np.inf, 1.0, 1e-3), tops > floor
    for decay in np.arange(0.2, 5.01, 0.05):
        weight = float((sizes * np.exp(-decay * np.maximum(tops, floor))).sum())
        k = max(float(beyond.sum()), 0.5) / weight
        found = max(found, (beyond.sum() * math.log(k * decay) - decay * tops[beyond].sum() - k * weight, float(decay), k))
    return found[1], found[2]


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Bias and slope by damped Newton steps, with a ridge that keeps separable data finite."""
    if not len(y) or y.min() == y.max():
        return -20.0, 0.0

    def loss(w):
        z = w[0] + w[1] * x
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * w[1] * w[1]

    w, now = np.zeros(2), np.inf
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + w[1]])
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1.0]])
        step, size = np.linalg.solve(h, g), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - after < 1e-9:
            break
        now = after
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` and its text, with ``score`` double, ``predicted`` int and ``passages`` array.

    A passage gives first token, end token, sum of log-odds and expected number in clean text of its length. Null and
    empty texts have no tokens and get the calibrated probability of no evidence. Rows are judged one by one, so
    repeated rows repeat and an empty table stays empty. ``prefix`` sets the new columns apart from clashing names.
    """

    def make():
        scorer = Scorer(model)

        def judge(texts):
            out = []
            for t in texts:
                evidence, found = scorer.evidence(tokens(t))
                p = scorer.probability(evidence)
                out.append((p, int(p >= THRESHOLD), [dict(zip(("first", "end", "sum", "expected"), x, strict=True)) for x in found]))
            return out

        return judge

    fields = f"{prefix}score double, {prefix}predicted int, {prefix}passages array<struct<first:int,end:int,sum:double,expected:double>>"
    return judged(docs, [*columns, f"`{text_col}`"], make, fields)


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id``, ``held_out`` (crc32 of the id mod ``held_out_of`` is ``held_out``), ``score``, ``predicted``, ``n_passages``.

    Labels of held-out ids take no part in fitting. See ``fit`` and ``score`` for null, empty and repeated rows.
    """
    model = fit(docs, labels.filter(crc_mod("doc_id", held_out_of) != held_out))
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return score(base, model, ["doc_id"]).select("doc_id", (crc_mod("doc_id", held_out_of) == held_out).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
