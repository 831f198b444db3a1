"""Token ids of whole texts, through a bounded cache of words.

A BPE tokenizer never merges across its pre-tokens, so a text can be cut wherever a pre-token is sure to
end and the pieces' ids joined. For the two kinds of pre-tokenizer below, that is before every space after a
non-space; each such word is then encoded once and its ids kept as bytes. Any other tokenizer, and any text with
unusual spacing, is encoded whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|]*)")
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　] ")
_ODD_SPLIT = re.compile("[\x1c-\x1f]")
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _BYTES]
BYTE_CHAR = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(_REST)}
CACHE_BYTES = 96 << 20


def _byte_level(s: str) -> str:
    return s if s.isascii() else "".join(map(BYTE_CHAR.__getitem__, s.encode()))


class _Words(dict):
    """word -> bytes of its ids; fills itself. When about half of ``CACHE_BYTES`` is full a new generation starts, and words of the one before
    move over as they are met again, so common words stay and rare ones go."""

    def __init__(self, owner: Encoder):
        self.owner, self.bytes, self.before = owner, 0, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.pop(word, None)
        if ids is None:
            ids = self.owner.encode_word(word)
        if 2 * self.bytes >= CACHE_BYTES:
            self.before, self.bytes = dict(self), 0
            self.clear()
        self[word] = ids
        self.bytes += 200 + 2 * len(word) + len(ids)  # with what the objects themselves take
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.marks: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            self.kind = "space_first"
        elif (
            pre.get("type") == "Sequence"
            and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["behavior"] == "Removed"
            and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", "")
            and norm
            and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        ):
            self.kind = "no_space"
        self.words = _Words(self)

    def _pack(self, ids) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _token(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.tokenizer.model.tokenize(piece)])

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = self._token(marks) if marks else b""
        return self.marks[marks]

    def encode_word(self, word: str) -> bytes:
        """A word that follows a space; the space belongs to it if the tokenizer keeps spaces."""
        if plain := _LETTERS.fullmatch(word):
            letters, marks = plain.groups()
            if marks:
                return self.words[letters] + self._mark(marks)
            if self.kind == "no_space":
                low = letters.lower()
                return self._token(_byte_level(low)) if low == letters else self.words[low]
            return self._token("Ġ" + _byte_level(letters))
        if self.kind == "no_space":
            return self.whole(word)
        before, line_end, after = word.partition("\n")
        if line_end and _LETTERS.fullmatch(before) and (plain := _LETTERS.fullmatch(after)):
            return self.words[before] + self._mark("Ċ") + self._token(_byte_level(plain[1])) + self._mark(plain[2])
        return self.whole(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian integers of ``dtype``."""
        if self.kind == "no_space" and not _ODD_SPLIT.search(text):
            return b"".join(map(self.words.__getitem__, text.split()))
        if self.kind == "space_first" and not ("  " in text or "\n " in text or _RARE_SPACE.search(text)):
            first, *rest = text.split(" ")
            return self.whole(first) + b"".join(map(self.words.__getitem__, rest))
        return self.whole(text)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
