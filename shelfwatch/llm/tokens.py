"""Token ids of whole texts with a public vocabulary file.

The vocabularies split a text into pieces and encode every piece alone, so a piece is
encoded once by the tokenizers library and its ids are looked up afterwards.  That holds
for texts of common Latin characters without the vocabulary's special strings; every
other text goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

# The splitting patterns of the two kinds of files, over Latin characters.
LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ž"
LATIN_DIGIT = "0-9²³¹¼-¾"
LATIN_SPACE = r" \t-\r\x85\xa0"
ASCII_ONLY = ("A-Za-z", "0-9", r" \t-\r")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
UNSURE = re.compile(r"[^\t-\r -~¡-įı-ž–—‘-”…€]")
CACHE_PIECES = 500_000


def byte_level(letter: str, digit: str, space: str) -> str:
    """A piece takes the space before it; other white space stands alone."""
    other = f"[^{space}{letter}{digit}]+"
    return f"{ENDINGS}| ?[{letter}]+| ?[{digit}]+| ?{other}|[{space}]+(?![^{space}])|[{space}]+"


def word_level(letter: str, digit: str, space: str) -> str:
    """White space is dropped and every digit is a piece."""
    return f"{ENDINGS}|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces; a piece that is looked up for the first time is encoded by the library."""

    def __init__(self, model, width: int):
        super().__init__()
        self._model, self._code = model, {2: "H", 4: "I"}[width]
        self._letters = str.maketrans({i: c for i, c in enumerate(byte_letters())})

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self._letters)
        ids = array(self._code, [t.id for t in self._model.tokenize(letters)]).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian ids of `width` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._lower = spec.get("normalizer") is not None
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        rule = {(False, "ByteLevel"): byte_level, (True, "Sequence"): word_level}.get((self._lower, kind))
        latin = (LATIN_LETTER, LATIN_DIGIT, LATIN_SPACE)
        self._split = [re.compile(rule(*c)).findall for c in (latin, ASCII_ONLY)] if rule else None
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if self._tokenizer.get_vocab_size() <= 65536 else 4
        self._type = np.dtype(f"<u{self.width}")
        self._pieces = Pieces(self._tokenizer.model, self.width)

    def _library(self, text: str) -> bytes:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=self._type).tobytes()

    def encode(self, text: str) -> bytes:
        if self._split is None or UNSURE.search(text) or any(s in text for s in self._special):
            return self._library(text)
        if len(self._pieces) > CACHE_PIECES:
            self._pieces.clear()
        pieces = self._split[text.isascii()](text.lower() if self._lower else text)
        return b"".join(map(self._pieces.__getitem__, pieces))

    def release(self) -> None:
        """Forgets the pieces seen so far; to be called when a task ends, since the worker outlives it."""
        self._pieces.clear()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
