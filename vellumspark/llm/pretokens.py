r"""Pre-tokens of byte-level BPE, and how texts are cut into independent fragments first.

A text may be cut before each space that stands between two characters that are no white space: no match of the
pattern spans such a place (its classes take a space only in front, and white-space runs end before it), and no
match on either side looks across it. So the pre-tokens of a text are those of its fragments in order, and the
pattern, the slow part, runs once for each distinct fragment.
"""

from __future__ import annotations

import base64
import re

import public_tokenizers

_CUT = re.compile(r"(?<=\S) (?=\S)")


def pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def read_ranks(spark, path: str) -> list[tuple[bytes, int]]:
    """The (token bytes, rank) rows of a rank file; its size is that of a vocabulary, not of any data."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in f if x.strip())]


def fragments(text: str) -> list[str]:
    """The fragments of a text; all but the first are meant with a space in front, which is left out."""
    ws = text.split()
    if len(text) - sum(map(len, ws)) == len(ws) - 1:  # no two white spaces touch and none is at an end
        return text.split(" ")
    return _CUT.split(text)


def spaced(f: str, find) -> list[str]:
    """The pre-tokens of a fragment with its space in front; letters alone, or with one stop after them, need no search."""
    if f.isalpha():
        return [" " + f]
    if f[-1] in ".,;:!?" and f[:-1].isalpha():
        return [" " + f[:-1], f[-1]]
    return find(" " + f)


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, k):
        self[k] = v = len(self)
        return v
