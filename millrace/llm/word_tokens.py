"""Encoding with the lower-casing word tokenizer of the tokenizers library, word by word through a bounded cache.

The tokenizer collapses white space and no token spans it, so a text's ids are those of its pieces between
spaces and line feeds, put together. Words repeat: a piece's ids are kept, and only pieces not met before go to
the library.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Pieces kept by a worker: two generations of this many.
CACHE = 300_000
#: Longer pieces are encoded but not kept.
KEPT_CHARS = 64

#: Lower-case letters that the normaliser leaves as they are: a piece of these alone is one word for the model.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The model's letters for the UTF-8 bytes of Latin-1 characters: a byte that is no printable Latin-1 character stands as the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(moved)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


BYTE_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """``ids(text)``: the ids as ``add_special_tokens=False`` gives them, as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has more than 65,536 ids")
        if sys.byteorder != "little":
            raise ValueError("ids are kept as little-endian numbers")
        self.model = self.tokenizer.model
        self.marks = {c: array("H", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,"}
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _encode(self, piece: str) -> bytes:
        """The ids of a piece that is in neither generation."""
        end = piece[-1]
        # a comma or full stop after a letter begins a token, and here ends it
        marked = end in ".," and len(piece) > 1 and piece[-2].isalpha()
        low = (piece[:-1] if marked else piece).lower()
        if not PLAIN.fullmatch(low):
            return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        word = self.young.get(low) or self.old.get(low)
        if word is None:
            word = array("H", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(BYTE_LETTERS))]).tobytes()
            if len(low) <= KEPT_CHARS:
                self.young[low] = word
        return word + self.marks[end] if marked else word

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of ``pieces`` into the young generation."""
        for p in pieces:
            known = self.old.get(p)
            self.young[p] = self._encode(p) if known is None else known

    def ids(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        missing = [p for p in set(pieces) if p not in self.young]
        if missing:
            if len(self.young) > CACHE:
                self.old, self.young = self.young, {"": b""}
                missing = [p for p in set(pieces) if p not in self.young]
            self._learn(missing)
        got = b"".join(map(self.young.__getitem__, pieces))
        for p in missing:
            if len(p) > KEPT_CHARS:
                del self.young[p]
        return got


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between its tasks."""
    return WordEncoder(path)


def ids32(raw: bytes, end: int | None = None) -> np.ndarray:
    """16-bit ids as little-endian 32-bit ones, with ``end`` appended."""
    found = np.frombuffer(raw, "<u2").astype("<u4")
    return found if end is None else np.append(found, np.array([end], "<u4"))
