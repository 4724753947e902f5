"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns give the base spans. The network, trained in numpy from labelled spans, reads overlapping windows around
every place that could be part of personal data (a digit or ``@``; a span without either, or longer than a window less
its step, is never taken), its tags are
decoded by the Viterbi algorithm, and the windows' spans are reconciled over the whole text: where windows disagree,
the one in which a span lies nearest the middle decides. Spans that overlap a base span, cut a word or number or don't have their
kind's form are dropped.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and of its step: every span of up to ``WINDOW - STEP + 1`` characters lies in a window whole.
WINDOW, STEP = 96, 32
#: Texts that fitting reads at most, least hash first, and their parts around digits or ``@`` (the first ones); windows
#: and updates of training. The labelled sample is bounded by these.
FIT_TEXTS, FIT_PARTS, FIT_WINDOWS, UPDATES, LANES = 600, 8, 2400, 220, 64
HIDDEN = 12
#: Windows decoded together.
BATCH = 2048

_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_HERE = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@]+")


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(number)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in parts)


def is_card(text: str) -> bool:
    number = digits(text)
    return 12 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern in linear time: a match starts where a run of name characters does, or right after a match."""
    out, at = [], 0
    if "@" not in text:
        return out
    while True:
        found = (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not found:
            return out
        out.append(found.span())
        at = found.end()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of base spans, by start, then kind."""
    if not text:
        return []
    out = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        for k, pattern, fits in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
            out += [(*m.span(), k) for m in pattern.finditer(text) if fits(m.group())]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Forms that spans of the network must have (looser than the base patterns).
_FORMS = (
    lambda t: bool(re.fullmatch(rf"[{_LOCAL}]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+", t)),
    lambda t: bool(re.fullmatch(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}", t)) and is_ip(t.replace(" ", "")),
    lambda t: bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", t)) and is_card(t),
    lambda t: bool(re.fullmatch(r"[(0-9][0-9 ()./-]+[0-9]", t)) and 10 <= len(digits(t)) <= 15 and bool(re.search(r"[ ()./-]", t)),
)

# symbols: a class a character
_CLASSES = {c: i for i, c in enumerate("@.-_%+() :/=,\n\"'#!&$|", start=5)}
SYMBOLS = 5 + len(_CLASSES) + 1


def encode(text: str) -> np.ndarray:
    """Class of each character: 1 lower, 2 upper, 3 digit, 4 other letter, then marks; 0 stands outside the text."""
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text):
        if "a" <= c <= "z":
            out[i] = 1
        elif "A" <= c <= "Z":
            out[i] = 2
        elif "0" <= c <= "9":
            out[i] = 3
        else:
            out[i] = _CLASSES.get(c, 4 if c.isalpha() else SYMBOLS - 1)
    return out


#: Tags: 0 outside; 1 + 2k begin, 2 + 2k inside of kind k.
TAGS = 1 + 2 * len(KINDS)


class Tagger:
    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.h = hidden
        self.p = {k + d: make(n, 4 * hidden) for d in "fb" for k, n in (("x", SYMBOLS), ("u", hidden))}
        for d in "fb":
            self.p["x" + d][:, hidden : 2 * hidden] += 1.0  # forget gates start open
        self.p |= {"o": make(2 * hidden, TAGS), "ob": np.zeros(TAGS, np.float32), "t": make(TAGS, TAGS), "s": np.zeros(TAGS, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, (rows, time) = self.h, x.shape
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out, trail = np.empty((time, rows, n), np.float32), []
        for t in range(time) if d == "f" else reversed(range(time)):
            a = self.p["x" + d][x[:, t]] + h @ self.p["u" + d]
            g = np.tanh(a[:, 3 * n :])
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * n], -30, 30)))
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            c0, h0 = c, h
            c = f * c0 + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trail.append((t, h0, c0, i, f, o, g, tc))
        return out, trail

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores (time, rows, tags) of windows of symbols."""
        f, tf = self._run(x, "f", keep)
        b, tb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["o"] + self.p["ob"], both, tf, tb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequences (rows, time) by Viterbi."""
        e, *_ = self.emissions(x)
        time, rows, _ = e.shape
        score, back = e[0] + self.p["s"], np.empty((time, rows, TAGS), np.int8)
        for t in range(1, time):
            all_ = score[:, :, None] + self.p["t"]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        out = np.empty((rows, time), np.int64)
        out[:, -1] = score.argmax(1)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(rows), out[:, t]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Gradients of the mean negative log-likelihood of tag sequences ``y``, and that mean."""
        e, both, tf, tb = self.emissions(x, keep=True)
        time, rows, _ = e.shape
        p, r = self.p, np.arange(rows)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + p["s"]
        for t in range(1, time):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
        for t in range(time - 2, -1, -1):
            beta[t] = lse(p["t"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = p["s"][y[:, 0]] + sum(e[t][r, y[:, t]] for t in range(time)) + sum(p["t"][y[:, t - 1], y[:, t]] for t in range(1, time))
        de = np.exp(alpha + beta - z[:, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(1, time):
            g["t"] += np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(g["t"], (y[:, t - 1], y[:, t]), -1)
        for t in range(time):
            de[t][r, y[:, t]] -= 1
        g["s"] = de[0].sum(0)
        flat = de.reshape(-1, TAGS)
        g["o"], g["ob"] = both.reshape(-1, 2 * self.h).T @ flat, flat.sum(0)
        dh = (flat @ p["o"].T).reshape(time, rows, 2 * self.h)
        for d, trail, part in (("f", tf, dh[:, :, : self.h]), ("b", tb, dh[:, :, self.h :])):
            hn, cn = np.zeros((rows, self.h), np.float32), np.zeros((rows, self.h), np.float32)
            for t, h0, c0, i, f, o, a, tc in reversed(trail):
                h = part[t] + hn
                c = cn + h * o * (1 - tc * tc)
                da = np.concatenate([c * a * i * (1 - i), c * c0 * f * (1 - f), h * tc * o * (1 - o), c * i * (1 - a * a)], 1)
                np.add.at(g["x" + d], x[:, t], da)
                g["u" + d] += h0.T @ da
                hn, cn = da @ p["u" + d].T, c * f
        return {k: v / rows for k, v in g.items()}, float((z - gold).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, updates: int = UPDATES, seed: int = 5) -> float:
        rng, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for step in range(1, updates + 1):
            few = rng.choice(len(x), min(LANES, len(x)), replace=False)
            g, loss = self.gradients(x[few], y[few])
            norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
            for k in g:
                a = g[k] * min(1.0, 5 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * a, 0.99 * v.get(k, 0) + 0.01 * a * a
                self.p[k] -= 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return loss


def windows(text: str) -> list[int]:
    """Starts of overlapping windows on a fixed grid that hold a digit or ``@``; a span that holds one lies in one of them."""
    found: set[int] = set()
    for m in _TRIGGER.finditer(text):
        first, last = m.start() // STEP, (m.end() - 1) // STEP
        found.update(range(first - WINDOW // STEP + 1, last + 1))
    return [k * STEP for k in sorted(found)]


def _cut(codes: np.ndarray, start: int) -> np.ndarray:
    """A window's symbols; outside the text they are 0."""
    out = np.zeros(WINDOW, np.int64)
    a, b = max(0, start), min(len(codes), start + WINDOW)
    if a < b:
        out[a - start : b - start] = codes[a:b]
    return out


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, i, n = [], 0, len(tags)
    while i < n:
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < n and tags[j] == tags[i] + 1:
                j += 1
            out.append((i, j, (int(tags[i]) - 1) // 2))
            i = j
        else:
            i += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind, distance from its window's middle) of all windows: nearest the middle first, none overlapping.

    Taken spans are kept disjoint and in order, so each test is a bisection, however many spans a text has.
    """
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(base):  # base spans of different kinds may overlap: their union
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for a, b, k, _ in sorted(set(found), key=lambda s: (s[3], s[0], s[2], s[1])):
        while b > a and text[b - 1] in " \n.,":
            b -= 1
        while a < b and text[a] in " \n.,":
            a += 1
        at = bisect_left(taken, (b, 0))  # the spans before it begin before b
        free = at == 0 or taken[at - 1][1] <= a
        whole = not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum()
        if b > a and free and whole and _FORMS[k](text[a:b]):
            insort(taken, (a, b))
            out.append((a, b, k))
    return out


class Finder:
    def __init__(self, tagger: Tagger | None):
        self.tagger = tagger

    def find(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """Base spans and added spans of each text; windows of all texts are decoded together."""
        base, starts, cut = [base_spans(t) for t in texts], [], []
        added: list[list] = [[] for _ in texts]
        for i, t in enumerate(texts):
            if t and self.tagger is not None:
                for a in windows(t):
                    part = t[max(0, a) : a + WINDOW]
                    starts.append((i, a))
                    cut.append(_cut(encode(part), min(0, a)))
        for at in range(0, len(cut), BATCH):
            tags = self.tagger.decode(np.stack(cut[at : at + BATCH]))
            for (i, start), row in zip(starts[at : at + BATCH], tags, strict=True):
                if row.any():
                    for a, b, k in tagged_spans(row):
                        x, y = start + a, min(start + b, len(texts[i]))
                        if 0 <= x < y:
                            added[i].append((x, y, k, abs(a + b - WINDOW) / 2))
        return [(b, reconcile(x, b, t) if x else []) for b, x, t in zip(base, added, texts, strict=True)]


def variant(text: str, kind: int, rng: np.random.Generator) -> str:
    """A span as people also write it and the patterns miss; it keeps its label."""
    if kind == 0:
        return text.replace("@", (" @ ", " @", "@ ")[rng.integers(3)])
    if kind == 1:
        return text.replace(".", (" . ", ". ")[rng.integers(2)])
    if kind == 2:
        number = digits(text)
        return (".", "/")[rng.integers(2)].join(number[i : i + 4] for i in range(0, len(number), 4))
    number = digits(text)
    parts = [number[:3], number[3:6], number[6:]] if len(number) > 8 else [number[:4], number[4:]]
    return ("-", ".", " ")[rng.integers(3)].join(parts) if rng.integers(2) else f"({parts[0]}) " + "-".join(parts[1:])


def training_windows(texts: list[str], most: int = FIT_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags around base spans, some rewritten, and as many without any span."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for t in texts:
        spans = base_spans(t)
        for a, b, k in spans:
            if any(s[0] < b and a < s[1] and s != (a, b, k) for s in spans) or b - a > WINDOW - 8:
                continue
            shown = variant(t[a:b], k, rng) if rng.integers(2) else t[a:b]
            lead = int(rng.integers(2, WINDOW - 4 - min(len(shown), WINDOW - 8)))
            before, after = t[max(0, a - lead) : a], t[b : b + WINDOW]
            if base_spans(before + " ") or base_spans(" " + after):
                continue
            codes = encode(before + shown + after)[:WINDOW]
            y = np.zeros(WINDOW, np.int64)
            y[len(before) : len(before) + len(shown)] = 2 + 2 * k
            y[len(before)] = 1 + 2 * k
            xs.append(_cut(codes, 0))
            ys.append(y)
        at = int(rng.integers(max(1, len(t))))
        plain = re.sub("[0-9@]+", lambda m: str(rng.integers(10 ** int(rng.integers(1, 5)))), t[at : at + WINDOW])
        xs.append(_cut(encode(plain), 0))
        ys.append(np.zeros(WINDOW, np.int64))
        if len(xs) >= most:
            break
    return (np.stack(xs), np.stack(ys)) if xs else (np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64))


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """Train on base spans of ``FIT_TEXTS`` texts at most (those of digits or ``@``, least hash first); None without any."""
    marked = docs.select(docs[text_col].alias("text")).filter(F.col("text").rlike(r"[0-9]{3}|@")).select("text", F.xxhash64("text").alias("h"))
    least = marked.select("h").distinct().orderBy("h").limit(FIT_TEXTS)
    rows = marked.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("h", F.expr("regexp_extract_all(text, '(?s).{0,96}(?:[0-9]{3}|@).{0,96}', 0)").alias("parts"))
    texts = [p for r in sorted(rows.select("h", F.slice("parts", 1, FIT_PARTS).alias("parts")).collect(), key=lambda r: r["h"]) for p in r["parts"]]
    x, y = training_windows(texts)
    if not (y > 0).any():
        return None
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_pii(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the numbers of base spans, the digest of the base spans, and all spans.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` long, ``base_sha256`` string (of
    ``kind:start:end`` in code points, comma-joined), ``spans`` string, ``n_added`` long (the network's spans). A null
    or empty text has no spans; a null id stays null; repeated rows repeat; an empty table gives no rows; other columns
    aren't read. Whole texts of any length are searched.
    """

    def make():
        finder = Finder(tagger)

        def judge(texts):
            out = []
            for base, added in finder.find(texts):
                n = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            return out

        return judge

    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return judged(base, ["doc_id", "text"], make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").drop("text")
