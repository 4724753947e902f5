"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree is a byte position and holds the rank of the pair that starts there (no pair: infinity);
each inner node holds the least (rank, position) below it, so the root names the leftmost pair of minimum rank.
A merge joins two live neighbours and updates three leaves, each in logarithmic time. Short pieces are merged
side by side as rows of one numpy tree; a long piece gets a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, text_slices

#: Rank of "no pair": above any vocabulary.
NONE = np.int64(1) << 30
#: Pieces of more bytes than this get a tree of their own.
SHORT = 256
#: Bytes of pieces that a task remembers; beyond it the memory is emptied. Longer pieces than ``KEPT`` aren't remembered.
REMEMBERED, KEPT = 40_000_000, 128
#: Pieces of texts that are encoded together.
CHUNK = 100_000


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, with the table of all pairs of tokens that join to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.base = max(self.bytes) + 1
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids; ``NONE`` where they don't join or one is missing (negative)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """Token ids of one piece, by a tree of its own."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        token = [self.ranks[piece[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, base, pairs = int(NONE) * size, self.base, self.pairs
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = pairs.get(token[i] * base + token[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(i: int) -> None:
            j = after[i] if token[i] >= 0 else n
            r = pairs.get(token[i] * base + token[j]) if j < n else None
            at = size + i
            tree[at] = none if r is None else r * size + i
            at >>= 1
            while at:
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while tree[1] < none:
            r, i = divmod(tree[1], size)
            j = after[i]
            token[i], token[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            update(j)
            update(i)
            if before[i] >= 0:
                update(before[i])
        return [t for t in token if t >= 0]

    def merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of pieces of at most ``size`` bytes, a power of two: one tree a row."""
        rows = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(rows, size)
        at = np.arange(size)
        token = np.where(at < lengths[:, None], self.single[raw], -1)
        token = np.concatenate([token, np.full((rows, 1), -1)], 1)  # the last column stands for "no neighbour"
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (rows, 1))
        before = np.tile(np.arange(-1, size), (rows, 1))
        before[:, 0] = size
        tree = np.full((rows, 2 * size), NONE * size)
        r = self.rank(token[:, :-1], token[:, 1:])
        tree[:, size:] = np.where(r < NONE, r * size + at, NONE * size)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE * size)
        while len(live):
            rank, i = np.divmod(tree[live, 1], size)
            j = after[live, i]
            token[live, i], token[live, j] = rank, -1
            k = after[live, j]
            after[live, i], before[live, k] = k, i
            h = before[live, i]
            for x, y in ((j, None), (i, k), (h, i)):
                if y is None:
                    leaf = NONE * size
                else:
                    r = self.rank(token[live, x], token[live, y])
                    leaf = np.where(r < NONE, r * size + x, NONE * size)
                x = np.minimum(x, size - 1) + size  # a missing neighbour's update lands on the last leaf ...
                if y is i:
                    leaf = np.where(h < size, leaf, tree[live, x])  # ... and leaves it as it is
                tree[live, x] = leaf
                while (x := x >> 1)[0]:
                    tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            live = live[tree[live, 1] < NONE * size]
        flat = token[:, :-1].astype("<i4")
        kept = flat >= 0
        ids, ends = flat[kept].tobytes(), np.cumsum(kept.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, each merged separately."""
        out, by_size = {}, {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                out[piece] = np.array(self.merge_long(raw), "<u4").tobytes()
            else:
                by_size.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, found in by_size.items():
            step = max(16, 65_536 // size)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                out.update(zip((p for p, _ in part), self.merge_rows([r for _, r in part], size), strict=True))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that token ids stand for."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Codec:
    """Encodes whole texts by a pattern and a vocabulary, remembering the pieces that come up."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split, self.known, self.held = Vocabulary(path), regex.compile(pattern), {}, 0

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some pieces."""
        new = self.vocabulary.encode_pieces(set(pieces).difference(self.known))
        out = [self.known.get(p) or new[p] for p in pieces]
        size = sum(len(p) + len(x) + 240 for p, x in new.items() if len(p) <= KEPT)
        if self.held + size > REMEMBERED:
            self.known, self.held = {}, 0
        self.known.update((p, x) for p, x in new.items() if len(p) <= KEPT)
        self.held += size
        return out

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, ``CHUNK`` pieces at a time: however long the text, few pieces are held as objects."""
        pieces = map(regex.Match.group, self.split.finditer(text))
        while part := list(islice(pieces, CHUNK)):
            yield b"".join(self.ids(part))

    def encode_all(self, texts: list[str]) -> list[Iterator[bytes]]:
        """Ids of short texts; their pieces are encoded together."""
        pieces = [self.split.findall(t) for t in texts]
        ids = iter(self.ids([p for part in pieces for p in part]))
        return [[b"".join(islice(ids, len(part)))] for part in pieces]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to.

    Returns ``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit; only with ``keep_ids``),
    ``ids_sha256`` and ``decoded_sha256`` string (lowercase hex), ``round_trip`` boolean (decoded bytes = text).

    A null or empty text has no tokens (digests of no bytes). A null id stays null; repeated rows give repeated
    rows; other columns of ``docs`` are not read, so their names can't clash. An empty table gives no rows.
    Texts are encoded within a task, without a shuffle; a text of any length is taken whole, in parts of its pieces, so
    that a task holds a bounded number of pieces, and ids only where they are kept.
    """
    schema = "doc_id long, n_tokens long" + ", ids binary" * keep_ids + ", ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def judge(codec: Codec, text: str, parts: Iterable[bytes]) -> tuple:
        """Number and digests of ids, and whether they decode to the text, part by part."""
        size, whole, kept, ids, decoded, raw = 0, True, [], hashlib.sha256(), hashlib.sha256(), text.encode("utf-8", "surrogatepass")
        at = 0
        for part in parts:
            back = codec.vocabulary.decode(np.frombuffer(part, "<u4"))
            ids.update(part)
            decoded.update(back)
            whole = whole and raw.startswith(back, at)
            size, at = size + len(part) // 4, at + len(back)
            if keep_ids:
                kept.append(part)
        return (size, *([b"".join(kept)] if keep_ids else []), ids.hexdigest(), decoded.hexdigest(), whole and at == len(raw))

    kinds = [pa.int64(), *([pa.binary()] if keep_ids else []), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for part in text_slices(batches, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = codec.encode_all(texts) if sum(map(len, texts)) <= SLICE_BYTES else [codec.encode(t) for t in texts]
            rows = zip(*(judge(codec, t, x) for t, x in zip(texts, ids, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
