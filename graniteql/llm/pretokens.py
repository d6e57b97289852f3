"""Splits texts by the public byte-level pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import regex

#: The classes L, N and white space of the pattern among the code points below U+0250.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = " \t\n\x0b\x0c\r\x85\xa0"

#: Texts of these characters only take the faster engine; the class has no character on which engines differ.
LATIN = re.compile(f"[\t\n\x0b\x0c\r\x20-\x7e\xa0-ɏ‐-‧]*\\Z")
_latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Longer texts are split piece by piece, so that the list of their pre-tokens stays short.
LONG = 1_000_000

#: A blank between two word characters: pre-tokens end before it, whatever stands around.
_blank = re.compile(r"(?<=\w) (?=\w)")


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of a text of about a size, cut only where pre-tokens end; one part if there is no such place."""
    at = 0
    while len(text) - at > 2 * size and (found := _blank.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


#: Longest pre-token that is remembered.
KEPT_CHARS = 64


class Known(dict):
    """What a worker has resolved, of a bounded size: when the table is full it becomes the older one, from which
    what is still in use comes back, and what was older goes."""

    def __init__(self, most: int, find):
        self.most, self.find, self.old = most, find, {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.find(word)
        self.keep(word, value)
        return value

    def keep(self, word: str, value) -> None:
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = value


class Splitter:
    def __init__(self, pattern: str):
        # the pattern's white space is Unicode's White_Space, which lacks the four separators that Python counts as space
        self.general = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, in lists of a bounded length."""
        engine = _latin if LATIN.match(text) else self.general
        if len(text) < LONG:
            yield engine.findall(text)
            return
        found = engine.finditer(text)
        while part := [m.group() for m in islice(found, 200_000)]:
            yield part
