"""Text of web pages by a scanner with a state for each kind of markup, as HTML's own tokenizer has them.

Text runs to the next `<`. What follows decides: a comment runs to its end mark; a declaration or another odd `<!`, `<?` or
`</` to the next `>`; a tag over its attributes, whose quoted values may hold `>`; any other `<` is text. After the start tag
of a script, a style or another element whose body is no text the scanner skips to that element's end tag, whatever the body
looks like; in a title or a text area it takes the body as text without tags. References such as `&amp;` are decoded in text
alone. What is not closed runs to the end of the page. Each state moves by one compiled pattern that never goes back, so
a page takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose body is no text; elements whose body is text without tags; elements that begin and end a line.
SKIPPED = {"script", "style", "iframe", "noembed", "noframes"}
WHOLE = {"title", "textarea"}
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())

_SPACE = r"[\t\n\f\r ]"
_VALUE = rf"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >"'][^\t\n\f\r >]*+)?+"""
_ATTRIBUTE = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_SPACE}*+={_SPACE}*+{_VALUE})?+"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\t\n\f\r />]*+)(?:[\t\n\f\r /]++|{_ATTRIBUTE})*+(?:>|\Z)")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
ODD = re.compile(r"<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)|</>")


def named(names: Iterable[str]) -> Callable[[str], str]:
    """A decoder of these references alone, each with its semicolon; others stay as they stand."""
    known = re.compile("&(?:" + "|".join(map(re.escape, names)) + ");")
    return lambda text: known.sub(lambda m: unescape(m[0]), text)


def scanned(page: str, decode: Callable[[str], str] = unescape) -> Iterator[tuple[str, str]]:
    """Pieces of a page in order: ("text", decoded text), ("start", element), ("end", element)."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", decode(page[at:mark])
        if mark == size:
            return
        at = mark
        if tag := TAG.match(page, at):
            at, name = tag.end(), tag[2].lower()
            yield ("end" if tag[1] else "start"), name
            if not tag[1] and name in SKIPPED | WHOLE:
                close = re.compile(rf"</{re.escape(name)}(?=[\t\n\f\r />]|\Z)", re.I).search(page, at)
                end = close.start() if close else size
                if name in WHOLE and end > at:
                    yield "text", decode(page[at:end])
                at = end
        elif other := COMMENT.match(page, at) or ODD.match(page, at):
            at = other.end()
        else:
            yield "text", "<"
            at += 1


def plain(page: str, decode: Callable[[str], str] = unescape) -> str:
    """All text of a page, as it stands."""
    return "".join(x for kind, x in scanned(page, decode) if kind == "text")


def lines(page: str) -> str:
    """The text of a page in lines: an element that stands for itself begins and ends one, blanks are single, empty lines go."""
    out = [[]]
    for kind, x in scanned(page):
        if kind == "text":
            out[-1].append(x)
        elif x in BLOCKS:
            out.append([])
    return "\n".join(line for parts in out if (line := " ".join("".join(parts).split())))


def _column(f, page: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(f, na_action="ignore")

    return run(page)


def plain_text(page: Column, references: Iterable[str] | None = None) -> Column:
    """plain() of a column; null stays null. references: the names of those that are decoded, with their semicolon; all of
    HTML's, also the old ones without it, if none are given."""
    return _column(plain if references is None else partial(plain, decode=named(references)), page)


def text_lines(page: Column) -> Column:
    """lines() of a column; null stays null."""
    return _column(lines, page)
