"""Splitting a text into pre-tokens by the public pattern of a byte-level tokenizer."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import regex


def _class(categories: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] in categories)


@cache
def splitter(pattern: str):
    """A function from text to the list of all matches of ``pattern``.

    ``regex`` knows the pattern's Unicode classes. Texts of the first 256 code
    points, most of a Western corpus, go to the standard library's matcher,
    which is about twice as fast, with those classes spelled out for them.
    """
    whole = regex.compile(pattern).findall
    space = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
    letters, numbers = _class("L"), _class("N")
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    if "\\p" in spelled or re.search(r"\[[^\]]*\[", spelled.replace("\\[", "")):
        return whole
    narrow = re.compile(spelled).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return narrow(text)

    return split


class Memory:
    """What a worker has learned of pre-tokens, in two generations of at most about ``most`` bytes each (and one batch): once the young one is full it becomes the old one, of which only what is met again lives on."""

    ENTRY = 100  # bytes of a place in a dictionary

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Those that must be learned; the others are in ``young`` from now on."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = []
        for p in pieces.difference(self.young):
            if (known := self.old.get(p)) is None:
                new.append(p)
            else:
                self.keep(p, known)
        return new

    def keep(self, piece: str, value: bytes) -> None:
        self.young[piece] = value
        self.size += sys.getsizeof(piece) + sys.getsizeof(value) + self.ENTRY
