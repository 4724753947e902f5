"""Ids by files of public tokenizers, and the bytes that their entries stand for."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters of a text that are encoded at a time, unless it has no place to cut for longer.
PART_CHARS = 200_000

_PLACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def text_parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """A text in parts of about ``most`` characters, whose tokens are the whole text's.

    Parts begin with a single space between two characters that aren't white space (or U+2581, which piece vocabularies
    write for it). There byte-level patterns always begin a piece, and no entry of a piece vocabulary reaches across
    (``PieceBpe`` checks that).
    """
    at = 0
    while len(text) - at > most:
        found = _PLACE.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library.

    Its ids are computed by ``tiktoken``, which is four times as fast, if the file allows no difference: no normalizer,
    the usual pattern, merges in order of the ids that they make, and every entry reached by the file's own merges. Then,
    by induction over ids, both always join the same pair next: two neighbours that join to an entry are what the entry's
    own text is before its last merge, which is in the file. For other files ``tokenizers`` itself computes them.
    ``specials`` tells whether the strings of special tokens within texts are these tokens, as the library has it, or
    plain text.
    """

    def __init__(self, path: str, pattern: str, specials: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added, vocabulary = {x["content"]: x["id"] for x in spec["added_tokens"]}, spec["model"]["vocab"]
        alphabet = byte_alphabet()
        raw = {i: bytes(map(alphabet.__getitem__, k)) for k, i in vocabulary.items() if k not in added}
        raw |= {i: k.encode() for k, i in added.items()}
        self.bytes = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.quick = self._quick(spec, added, raw, pattern, specials)
        #: Whether the ids' bytes always are the text's: ``tiktoken`` writes any byte.
        self.lossless = self.quick is not None and {bytes([x]) for x in range(256)} <= set(self.bytes)

    def _quick(self, spec: dict, added: dict[str, int], raw: dict[int, bytes], pattern: str, specials: bool):
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        usual = usual and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        alone = lambda k: [x.id for x in self.library.model.tokenize(k)]
        if not usual or made != sorted(set(made)) or any(alone(k) != [i] for k, i in model["vocab"].items() if k not in added):
            return None
        import tiktoken

        own = set(added.values())
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: i for i, b in raw.items() if i not in own}, special_tokens=added if specials else {})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a part of a text, as int64."""
        if self.quick is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        if self.quick.special_tokens_set:
            return self.quick.encode_to_numpy(text, allowed_special="all").astype(np.int64)
        return np.array(self.quick.encode_ordinary(text), np.int64)


class PieceBpe:
    """A ``sentencepiece`` file; ``bytes`` are entries in UTF-8, with U+2581 as a space and ``<0xHH>`` as a byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(entries)]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        #: Whether texts may be cut before a space: no entry holds one behind another character.
        self.cuts = not any("▁" in x.lstrip("▁") for x in entries)

    def encode(self, part: str, first: bool) -> list[int]:
        """Ids of a part of a text; the library adds a space in front, which later parts bring with them."""
        return self.library.encode(part if first else part[1:])


@lru_cache(4)
def byte_level(path: str, pattern: str, specials: bool) -> ByteLevel:
    """One of each file a Python worker, for all its tasks."""
    return ByteLevel(path, pattern, specials)


@lru_cache(4)
def piece_bpe(path: str) -> PieceBpe:
    """One of each file a Python worker, for all its tasks."""
    return PieceBpe(path)


def read_text(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [t or "" for t in column.to_pylist()]
