"""Language-model scores of whole documents: a gated recurrent network over words with a class-factored softmax.

The most frequent words have outputs of their own, in classes of like frequency: the network gives the class, then the
word within it. Rarer words share static classes, within which a word's probability follows its corpus count. The
network is trained in numpy by backpropagation through windows of words whose state is carried over, and scores whole
documents the same way. Word counts and the network are learnt from all training documents: in each of a few rounds,
tasks train copies of the network on a share of the words each, and the copies' average begins the next round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, release, stored, text_slices, word_parts

#: Words (the most frequent) whose counts every task holds; rarer words' counts are joined.
HELD_WORDS = 200_000
#: Words with an output of their own, in classes of so many words.
HEAD_WORDS, CLASS_WORDS = 1024, 32
#: Static classes of held words that aren't in the head, by frequency; one more is for all rarer words.
STATIC_CLASSES = 8
HIDDEN, WINDOW, LANES = 16, 64, 256
#: Fitting goes once over all training words, in updates of so many lanes at most times window; where that gives fewer
#: updates than ``UPDATES``, there are fewer lanes (``LEAST_LANES`` at least), then repeated passes.
FIT_LANES, LEAST_LANES, FIT_WINDOW, UPDATES = 256, 8, 32, 400
#: Words that a task trains on in a round, about, and rounds at most.
TASK_WORDS, ROUNDS = 1_000_000, 8
#: Longer documents are trained on in pieces; a later piece begins with so many words more, which only warm its state up.
PIECE, WARM = 2_048, 32
#: Bytes of texts that a task scores side by side, and distinct words that it counts before it passes them on.
SCORED_BYTES, COUNTED = 16_000_000, 300_000
#: Trained copies that a task averages.
FAN = 32


class Lexicon:
    """Ids of held words; id 0 is the document's end, the last id stands for all rarer words."""

    def __init__(self, held: list[tuple[bytes, int]], ends: int, total: int, distinct: int):
        self.ids = {w: i + 1 for i, (w, _) in enumerate(held)}
        self.counts = np.array([ends, *(n for _, n in held)], np.float64)
        self.rare = len(self.counts)
        self.total, self.distinct = total, distinct
        self.norm = float(np.log10(total + distinct + 1))
        self.base = np.append(np.log10(self.counts + 1) - self.norm, 0.0)
        head = min(HEAD_WORDS, self.rare)
        self.head = head
        self.head_classes = -(-head // CLASS_WORDS)
        self.classes = self.head_classes + STATIC_CLASSES + 1
        # class and, for static words, log10 probability within the class, by id
        self.of = np.empty(self.rare + 1, np.int32)
        self.of[:head] = np.arange(head) // CLASS_WORDS
        within = np.zeros(self.rare + 1)
        rest = self.counts[head:] + 1
        share = np.cumsum(rest) / max(1.0, rest.sum())
        self.of[head : self.rare] = self.head_classes + np.minimum((share * STATIC_CLASSES).astype(np.int32), STATIC_CLASSES - 1)
        self.of[self.rare] = self.classes - 1
        for c in range(self.head_classes, self.classes - 1):
            mine = np.flatnonzero(self.of == c)
            within[mine] = np.log10((self.counts[mine] + 1) / (self.counts[mine] + 1).sum()) if len(mine) else 0.0
        self.within = within
        self.empty = np.setdiff1d(np.arange(self.classes), self.of)  # classes without a word
        # a rarer word within the last class: (count + 1) / (rare tokens + rare words + 1), the count being joined later
        self.rare_norm = float(np.log10(max(0.0, total - self.counts.sum()) + max(0, distinct - self.rare) + 1))
        self.input = np.where(np.arange(self.rare + 1) < head, np.arange(self.rare + 1), head + self.of - self.head_classes).astype(np.int32)
        # an id for each input; what an input stands for has one class
        self.stands = np.zeros(head + STATIC_CLASSES + 1, np.int32)
        self.stands[self.input[::-1]] = np.arange(self.rare, -1, -1)

    def encode(self, raw: bytes | None, rarer: Counter | None = None) -> np.ndarray:
        """Ids of an encoded text's words and its end; ``rarer`` counts the words that aren't held."""
        get, rare, out = self.ids.get, self.rare, []
        for found in word_parts(raw):
            out.append(np.fromiter(map(get, found, repeat(rare)), np.int32, len(found)))
            if rarer is not None:
                rarer.update(found[i] for i in np.flatnonzero(out[-1] == rare).tolist())
        return np.concatenate([*out, np.zeros(1, np.int32)])


def _safe(logits: np.ndarray) -> np.ndarray:
    """Logits, shifted by their rows' maxima where sums of their exponentials could leave single precision's range."""
    if not (logits.max(initial=0) < 60 and logits.min(initial=0) > -60):
        logits -= logits.max(1, keepdims=True)
    return logits


def _sums(rows: np.ndarray) -> np.ndarray:
    """Each row's sum."""
    return rows @ np.ones(rows.shape[1], rows.dtype)


class Network:
    """Gates, class softmax and word softmax; parameters are float32 arrays."""

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        inputs = lexicon.head + STATIC_CLASSES + 1
        self.p = {"x": make(inputs, 3 * hidden), "h": make(hidden, 3 * hidden), "c": make(hidden, lexicon.classes), "cb": np.zeros(lexicon.classes, np.float32), "w": make(lexicon.head_classes, hidden, CLASS_WORDS), "wb": np.zeros((lexicon.head_classes, CLASS_WORDS), np.float32)}
        last = lexicon.head - (lexicon.head_classes - 1) * CLASS_WORDS
        self.p["wb"][-1, last:] = -30.0  # places without a word
        self.p["cb"][lexicon.empty] = -30.0
        self.hidden, self.last = hidden, last

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = values[at : at + x.size].reshape(x.shape)
            at += x.size

    def steps(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of the window's inputs (lanes x time); ``fresh`` marks documents' starts, which zero the state."""
        n, lanes, time = self.hidden, *inputs.shape
        # gates apart, so that each step's operations run over whole arrays
        xs, us = self.p["x"][inputs.T], self.p["h"]
        xz, xm = xs[:, :, : 2 * n], xs[:, :, 2 * n :]
        uz, um = np.ascontiguousarray(us[:, : 2 * n]), np.ascontiguousarray(us[:, 2 * n :])
        out, on = np.empty((time, lanes, n), np.float32), (~fresh).T.astype(np.float32)[:, :, None]
        whole = on.all(axis=(1, 2))
        trail = tuple(np.empty((time, lanes, k * n), np.float32) for k in (1, 1, 2, 1)) if keep else None
        for t in range(time):
            if not whole[t]:
                h = h * on[t]
            a = h @ uz
            a += xz[t]
            np.maximum(a, -30, out=a)  # exp(30) is finite; beyond 30 a gate is 1 in single precision
            np.negative(a, out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            rec = h @ um
            m = a[:, n:] * rec
            m += xm[t]
            np.tanh(m, out=m)
            if keep:
                trail[0][t], trail[1][t], trail[2][t], trail[3][t] = h, rec, a, m
            h = h - m
            h *= a[:, :n]
            h += m
            out[t] = h
        return out, h, on, trail

    def log10(self, states: np.ndarray, targets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
        """log10 probabilities of targets (ids) after states; of rarer words only that of their class."""
        logits = states @ self.p["c"]
        logits += self.p["cb"]
        of = lexicon.of[targets]
        out = _safe(logits)[np.arange(len(of)), of]
        out -= np.log(_sums(np.exp(logits, out=logits)))
        order = np.argsort(of.astype(np.int16), kind="stable")
        ends = np.searchsorted(of[order], np.arange(lexicon.head_classes + 1))
        order = order[: ends[-1]]
        by_class, aim, more = states[order], targets[order], np.empty(len(order), np.float32)
        for c in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[c], ends[c + 1])
            s = by_class[mine] @ self.p["w"][c]
            s += self.p["wb"][c]
            own = _safe(s)[np.arange(len(s)), aim[mine] - c * CLASS_WORDS]
            more[mine] = own - np.log(_sums(np.exp(s, out=s)))
        out[order] += more
        return out.astype(np.float64) / np.log(10) + lexicon.within[targets]

    def gradients(self, inputs, fresh, targets, mask, h, lexicon):
        """Gradients of the mean loss over one window (truncated there), the state after it, the loss."""
        n, p = self.hidden, self.p
        out, last, on, trail = self.steps(inputs, fresh, h, keep=True)
        time, lanes, _ = out.shape
        states, of = out.reshape(-1, n), lexicon.of[targets.T.ravel()]
        aim, weight = targets.T.ravel(), mask.T.ravel().astype(np.float32) / max(1, mask.sum())
        g = {k: np.zeros_like(v) for k, v in p.items()}
        soft = states @ p["c"]
        soft += p["cb"]
        np.exp(_safe(soft), out=soft)
        soft *= (1 / _sums(soft))[:, None]
        loss = -(np.log(soft[np.arange(len(of)), of] + 1e-12) * weight).sum()
        soft[np.arange(len(of)), of] -= 1
        soft *= weight[:, None]
        g["c"], g["cb"] = states.T @ soft, _sums(soft.T)
        d = soft @ p["c"].T
        order = np.argsort(of.astype(np.int16), kind="stable")
        ends = np.searchsorted(of[order], np.arange(lexicon.head_classes + 1))
        by_class, aim, weight, more = states[order], aim[order], weight[order], np.zeros_like(states)
        for c in np.flatnonzero(np.diff(ends)):
            mine = slice(ends[c], ends[c + 1])
            s = by_class[mine] @ p["w"][c]
            s += p["wb"][c]
            np.exp(_safe(s), out=s)
            s *= (1 / _sums(s))[:, None]
            at = (np.arange(len(s)), aim[mine] - c * CLASS_WORDS)
            loss -= (np.log(s[at] + 1e-12) * weight[mine]).sum()
            s[at] -= 1
            s *= weight[mine, None]
            g["w"][c], g["wb"][c] = by_class[mine].T @ s, _sums(s.T)
            more[mine] = s @ p["w"][c].T
        d[order] += more
        d = d.reshape(time, lanes, n)
        # all that doesn't depend on later steps at once; backwards, gate by gate
        befores, rec, gates, m = trail
        z, r = np.ascontiguousarray(gates[:, :, :n]), np.ascontiguousarray(gates[:, :, n:])
        to_m = (1 - z) * (1 - m * m)
        to_z, to_r = (befores - m) * (z * (1 - z)), rec * (r * (1 - r))
        dx, back, uz, ur, um = np.empty((time, lanes, 3 * n), np.float32), np.zeros((lanes, n), np.float32), *(np.ascontiguousarray(p["h"][:, k * n : (k + 1) * n].T) for k in range(3))
        for t in reversed(range(time)):
            back += d[t]
            dz, am = back * to_z[t], back * to_m[t]
            dr = am * to_r[t]
            dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, am
            back *= z[t]
            back += dz @ uz
            back += dr @ ur
            am *= r[t]
            back += am @ um
            back *= on[t]
        du = dx.reshape(-1, 3 * n).copy()
        du[:, 2 * n :] *= r.reshape(-1, n)
        g["h"] = befores.reshape(-1, n).T @ du
        read = inputs.T.ravel().astype(np.int16)
        order = np.argsort(read, kind="stable")
        firsts = np.flatnonzero(np.diff(read[order], prepend=-1))
        g["x"][read[order][firsts]] = np.add.reduceat(dx.reshape(-1, 3 * n)[order], firsts, axis=0)
        g["wb"][-1, self.last :] = 0
        return g, last, loss


def packed(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in lanes of about equal length: ids, starts, document numbers (-1: nothing)."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    lanes = int(max(1, min(lanes, len(docs), lengths.sum() // max(1, lengths.max()) + 1)))
    ends, rows = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        lane = int(ends.argmin())
        rows[lane].append(i)
        ends[lane] += lengths[i]
    ids, starts, number = np.zeros((lanes, ends.max()), np.int32), np.zeros((lanes, ends.max()), bool), np.full((lanes, ends.max()), -1, np.int32)
    for lane, mine in enumerate(rows):
        at = 0
        for i in mine:
            ids[lane, at : at + lengths[i]], number[lane, at : at + lengths[i]], starts[lane, at] = docs[i], i, True
            at += lengths[i]
    return ids, starts, number


def _inputs(ids: np.ndarray, starts: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    before = np.concatenate([np.zeros((len(ids), 1), np.int32), ids[:, :-1]], 1)
    return lexicon.input[np.where(starts, 0, before)]  # a document begins after an end


def pieces(inputs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A document's inputs in pieces: words that only warm the state up, and the piece with them."""
    for at in range(0, len(inputs), PIECE):
        warm = min(at, WARM)
        yield warm, inputs[at - warm : at + PIECE]


def dealt(parts: list[tuple[int, np.ndarray]], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces laid end to end in lanes in their order, each in the shortest lane: inputs, starts, which words count."""
    lanes = min(lanes, len(parts))
    ends, places = np.zeros(lanes, np.int64), []
    for _, x in parts:
        lane = int(ends.argmin())
        places.append((lane, int(ends[lane])))
        ends[lane] += len(x)
    ids, starts, real = np.zeros((lanes, ends.max()), np.int32), np.zeros((lanes, ends.max()), bool), np.zeros((lanes, ends.max()), bool)
    for (lane, at), (warm, x) in zip(places, parts, strict=True):
        ids[lane, at : at + len(x)], starts[lane, at], real[lane, at + warm : at + len(x)] = x, True, True
    return ids, starts, real


class Adam:
    """A network's parameters with their running moments, as one vector each, and the number of updates made."""

    def __init__(self, values: np.ndarray, m: np.ndarray, v: np.ndarray, done: int):
        self.values, self.m, self.v, self.done = values, m, v, done

    def update(self, g: np.ndarray) -> None:
        self.done += 1
        rate = 0.01 * min(1.0, 20 / self.done + 0.3) * min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.values -= rate / (1 - 0.9**self.done) * self.m / (np.sqrt(self.v / (1 - 0.99**self.done)) + 1e-6)


def train(parts: list[tuple[int, np.ndarray]], lexicon: Lexicon, net: Network, state: Adam, lanes: int, least: int = 0) -> int:
    """One pass over all pieces (more until ``least`` updates are made), in windows of all lanes side by side.

    The state is carried from window to window. Gives the number of words that count.
    """
    ids, starts, real = dealt(parts, lanes)
    before = np.concatenate([np.zeros((len(ids), 1), np.int32), ids[:, :-1]], 1)
    inputs, targets = np.where(starts, 0, before), lexicon.stands[ids]
    ends, until = real.shape[1] - real[:, ::-1].argmax(1), state.done + least
    while True:
        h = np.zeros((len(ids), net.hidden), np.float32)
        for at in range(0, ids.shape[1], FIT_WINDOW):
            part = slice(at, at + FIT_WINDOW)
            live = np.flatnonzero(ends > at)
            net.load(state.values)
            g, h[live], _ = net.gradients(inputs[live, part], starts[live, part], targets[live, part], real[live, part], h[live], lexicon)
            state.update(np.concatenate([g[k].ravel() for k in net.p]))
        if state.done >= until:
            net.load(state.values)
            return int(real.sum())


def averaged(rows: Iterator[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """Words and the vectors' mean, weighted by words."""
    words_, total = 0, 0.0
    for n, values in rows:
        total = total + np.frombuffer(values, np.float32).astype(np.float64) * n
        words_ += n
    return words_, (total / max(1, words_)).astype(np.float32)


def fit(learn: DataFrame, lexicon: Lexicon, shared) -> Network:
    """The network learnt from all texts of ``learn`` (``doc_id``, ``text``); ``shared`` is the broadcast ``lexicon``.

    Pieces are dealt to rounds and tasks, and ordered there, by hash of their document and place: a long document is
    spread like many short ones. What a task holds is bounded by ``TASK_WORDS`` on average, and only vectors of the
    network's size leave it. Tasks average ``FAN`` copies each, again and again until there are no more than that, and the
    driver averages these.
    """
    net = Network(lexicon)
    if not lexicon.total:
        return net
    freq = np.bincount(lexicon.of[: lexicon.rare], lexicon.counts, lexicon.classes) + 1.0
    freq[-1] += max(0.0, lexicon.total - lexicon.counts.sum())
    net.p["cb"] = np.log(freq / freq.sum()).astype(np.float32)
    net.p["cb"][lexicon.empty] = -30.0
    rounds = max(1, min(ROUNDS, lexicon.total // TASK_WORDS))
    tasks = -(-lexicon.total // (rounds * TASK_WORDS))
    lanes = max(LEAST_LANES, min(FIT_LANES, lexicon.total // (UPDATES * FIT_WINDOW)))
    least = UPDATES if rounds * tasks == 1 else 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value[0]
        for part in text_slices(batches, 1):
            rows = [((key ^ (i * 0x9E3779B97F4A7C15)) // 64 % rounds, key, i, warm, x.tobytes()) for key, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True) for i, (warm, x) in enumerate(pieces(lex.input[lex.encode(raw.as_py())].astype(np.uint16)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["round", "key", "piece", "warm", "inputs"])

    # rows that share a null id and a text would otherwise share a key, however many
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()), "text").alias("key")
    cuts = stored(learn.select(key, "text").mapInArrow(cut, "round int, key long, piece int, warm int, inputs binary"), "lm-pieces")
    state = Adam(net.flat(), *(np.zeros_like(net.flat()) for _ in range(2)), 0)
    for k in range(rounds):
        begin = learn.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            lex, now = shared.value[0], begin.value
            mine, own, seen, held, parts = Network(lex), Adam(now.values.copy(), now.m.copy(), now.v.copy(), now.done), 0, 0, []
            for batch in batches:
                for warm, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts.append((warm, np.frombuffer(x, np.uint16)))
                    held += len(parts[-1][1])
                    if held > 4 * TASK_WORDS:
                        seen, held, parts = seen + train(parts, lex, mine, own, lanes), 0, []
            if parts:
                seen += train(parts, lex, mine, own, lanes, 0 if seen else least)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.done * seen], pa.int64()), pa.array([np.concatenate([own.values, own.m, own.v]).astype(np.float32).tobytes()], pa.binary())], ["n", "done", "vectors"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0

            def rows():
                nonlocal done
                for batch in batches:
                    for i in range(batch.num_rows):
                        done += batch.column(1)[i].as_py()
                        yield batch.column(0)[i].as_py(), batch.column(2)[i].as_py()

            n, mean = averaged(rows())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([done], pa.int64()), pa.array([mean.tobytes()], pa.binary())], ["n", "done", "vectors"])

        schema = "n long, done long, vectors binary"
        # a copy is 0.8 MB on disk: no more copies than planned, even where the session deals to more partitions
        copies = cuts.filter(F.col("round") == k).repartition(tasks, "key", "piece").coalesce(tasks).sortWithinPartitions("key", "piece").select("warm", "inputs").mapInArrow(run, schema)
        left = tasks
        while left > FAN or left == tasks:  # until the driver gets no more than ``FAN``, however many tasks there are
            left = -(-left // FAN)
            copies = copies.repartition(left).sortWithinPartitions("n", "vectors").mapInArrow(merge, schema)
            if left == 1:
                break
        found = copies.collect()
        begin.unpersist()
        if found:
            n, mean = averaged((r["n"], bytes(r["vectors"])) for r in found)
            state = Adam(*(x.copy() for x in np.split(mean, 3)), sum(r["done"] for r in found) // n)
    release(cuts)
    net.load(state.values)
    return net


def log_likelihoods(docs: list[np.ndarray], net: Network, lexicon: Lexicon) -> np.ndarray:
    """log10 probability of each whole document, but for the joined part of rarer words."""
    out = np.zeros(len(docs))
    ids, starts, number = packed(docs, LANES)
    inputs, h = _inputs(ids, starts, lexicon), np.zeros((len(ids), net.hidden), np.float32)
    for at in range(0, ids.shape[1], WINDOW):
        part = slice(at, at + WINDOW)
        live = np.flatnonzero((number[:, part] >= 0).any(1))
        states, h[live], _, _ = net.steps(inputs[live, part], starts[live, part], h[live])
        of, aim = number[live, part].T.ravel(), ids[live, part].T.ravel()
        real = np.flatnonzero(of >= 0)
        logs = net.log10(states.reshape(-1, net.hidden)[real], aim[real], lexicon)
        out += np.bincount(of[real], logs, len(docs))
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` binary and ``n`` of all words of all texts; tasks count first and pass on bounded tables of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                for found in word_parts(raw.as_py()):
                    held.update(found)
                    if len(held) > COUNTED:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return docs.select("text").filter("text is not null").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words and their counts, most frequent first: all of at least some count, ``most`` at most.

    The count comes from a histogram of a few hundred rows, so that no task ever sorts or gathers more words than these.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r[0]: r[1] for r in counts.groupBy(step).count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > most:
            break
        least, held = k, held + sizes[k]
    found = counts.filter(step >= least).select("word", "n").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", held_words: int = HELD_WORDS) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens`` long, ``base_score``, ``score`` double.

    ``training`` is a condition on ``doc_id``: the rows that counts and network are learnt from. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; each document ends with one token more. ``base_score`` sums
    log10((c + 1) / (N + V + 1)); ``score`` is the network's log10 probability. A null or empty text is that end alone.
    Without any training row all counts are 0 and the network is untrained. Rows are scored one by one: repeated rows
    repeat, a null id stays null, and an empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    learn = base.filter(training)
    counts = stored(word_counts(learn), "word-counts")
    ends = learn.count()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    lexicon = Lexicon(frequent(counts, held_words), ends, total, distinct)
    shared = spark.sparkContext.broadcast((lexicon, None))
    net = fit(learn, lexicon, shared)
    model = spark.sparkContext.broadcast((lexicon, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, network = model.value
        for part in text_slices(batches, 2, SCORED_BYTES):
            ids, tails = [], []
            for raw in part.column(2).cast(pa.binary()):
                tail: Counter = Counter()
                ids.append(lex.encode(raw.as_py(), tail))
                tails.append([{"word": w, "n": n} for w, n in tail.items()])
            sums = log_likelihoods(ids, network, lex)
            known = [int((x < lex.rare).sum()) if lex.counts[0] else int(((x < lex.rare) & (x > 0)).sum()) for x in ids]
            columns = [part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array([float(lex.base[x].sum()) for x in ids]), pa.array(sums), pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "held", "base_part", "part", "tail"])

    numbered = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = stored(numbered.mapInArrow(run, "row long, doc_id long, n_tokens long, held long, base_part double, part double, tail array<struct<word:binary,n:long>>"), "lm-parts")
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    rare = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"), F.sum("times").alias("times"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = parts.drop("tail").join(rare, "row", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("held") + zero("seen")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_part") + zero("logs") - zero("times") * lexicon.norm).alias("base_score"),
        (F.col("part") + zero("logs") - zero("times") * lexicon.rare_norm).alias("score"),
    )


def held_out_scores(docs: DataFrame, divisor: int = 7, held_out: int = 2) -> DataFrame:
    """``score_documents`` learnt from the ids whose crc32 mod ``divisor`` isn't ``held_out``, with column ``held_out``."""
    scored = score_documents(docs, crc_mod("doc_id", divisor) != held_out)
    return scored.select("doc_id", (crc_mod("doc_id", divisor) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
