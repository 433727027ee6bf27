"""Words of a text: runs of letters and numbers after normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import regex

# Characters without width that are removed.
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ASCII = regex.compile(r"[a-z0-9]+").findall
_ANY = regex.compile(r"[\p{L}\p{N}]+").findall


def words(text: str) -> list[str]:
    """NFKC, invisible characters removed, lower case, then the runs of categories L and N."""
    if text.isascii():
        return _ASCII(text.lower())
    return _ANY(unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower())


def myers(pattern: list[int]) -> Callable[[list[int]], tuple[int, int]]:
    """Bit-parallel search for a pattern of words: a function that gives the smallest edit distance of the pattern to any
    stretch of a sequence, and the place after that stretch (the first such)."""
    m = len(pattern)
    eq: dict[int, int] = {}
    for k, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)

    def search(sequence: list[int]) -> tuple[int, int]:
        pv, mv, score, best, where = full, 0, m, m, 0
        for at, w in enumerate(sequence, 1):
            e = eq.get(w, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            if score < best:
                best, where = score, at
            ph = ph << 1 & full  # a stretch may begin anywhere
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
        return best, where

    return search
