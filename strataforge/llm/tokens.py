"""Tokens on the case-folded canonical form: words of Latin letters, digit runs, neighbours in Han runs."""

from __future__ import annotations

import re
from operator import add

from .canonical import canonical

TOKEN = re.compile("[a-z][a-z0-9_.-]*|[0-9]+|[㐀-鿿]+")


def token_set(text: str) -> set[str]:
    """The distinct tokens; a Han run of one character has none."""
    found = set()
    for word in set(TOKEN.findall(canonical(text).casefold())):
        if word[0] < "㐀":
            found.add(word)
        else:
            found.update(map(add, word, word[1:]))
    return found


def similarity(a: set, b: set) -> float:
    """Shared tokens divided by all tokens; 0 if there are none."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0
