"""Plain-Python string helpers shared by the operators on typed names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

INVISIBLE = re.compile(r"[­​-‏‪-‮⁠﻿]")
#: Letters that don't decompose into a plain one and an accent. Fixed values.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ı": "i"})


@lru_cache(maxsize=200_000)
def fold(text: str) -> str:
    """Lower case without accents, invisible characters and doubled blanks; letters that don't decompose stay."""
    text = INVISIBLE.sub("", text).translate(LETTERS)
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(text.split())


def banded_distance(a: str, b: str, k: int) -> int:
    """The edit distance with neighbour swaps as one edit if it is at most k, else k + 1; only a band of 2k + 1 is filled."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > k:
        return k + 1
    # common ends cost nothing
    while n and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    start = 0
    while start < n and a[start] == b[start]:
        start += 1
    a, b, n, m = a[start:n], b[start:m], n - start, m - start
    if not n:
        return m if m <= k else k + 1
    big = k + 1
    before: list[int] = []
    last = [j if j <= k else big for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - k), min(m, i + k)
        row = [big] * (m + 1)
        if i <= k:
            row[0] = i
        best, x = big, a[i - 1]
        for j in range(low, high + 1):
            y = b[j - 1]
            d = last[j - 1] if x == y else 1 + min(last[j - 1], last[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            row[j] = d
            if d < best:
                best = d
        if best > k:
            return big
        before, last = last, row
    return min(last[m], big)


def segments(text: str, k: int) -> list[tuple[int, int, str]]:
    """(number, start, part) of the k + 1 even segments of a text; shorter texts have fewer."""
    n, parts = len(text), min(k + 1, max(1, len(text)))
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(i, cuts[i], text[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def letters(text: str) -> int:
    """The set of a text's characters as a bit mask of 64; each edit changes at most two bits."""
    mask = 0
    for c in text:
        mask |= 1 << (ord(c) & 63)
    return mask


class SegmentIndex:
    """An inverted index of the segments of some strings, for look-ups within the edits that their lengths allow.

    A string that may differ by k edits is cut into 2k + 1 segments, as a swap of neighbours can spoil two; one of them
    survives and is found at a place shifted by at most k. Hits whose letters differ too much aren't compared.
    """

    def __init__(self, strings, edits):
        self.edits = edits
        self.masks = {s: letters(s) for s in strings}
        self.parts: dict[tuple[int, int], dict[str, list[str]]] = {}
        self.plans: dict[int, list] = {}
        for s in self.masks:
            for number, _, part in segments(s, 2 * edits(len(s))):
                self.parts.setdefault((len(s), number), {}).setdefault(part, []).append(s)

    def _plan(self, n: int) -> list:
        """What a text of n characters looks up: (edits, index, places, size)."""
        plan = []
        for length in sorted({length for length, _ in self.parts}):
            k = self.edits(length)
            if abs(length - n) > k:
                continue
            count = min(2 * k + 1, length)
            for number in range(count):
                start, end = number * length // count, (number + 1) * length // count
                places = range(max(0, start - k), min(n - (end - start), start + k) + 1)
                if places and (length, number) in self.parts:
                    plan.append((k, self.parts[length, number], [(at, at + end - start) for at in places]))
        return plan

    def search(self, text: str) -> dict[str, int]:
        """The strings within their edits of the text, with the distances."""
        plan = self.plans.get(len(text))
        if plan is None:
            plan = self.plans[len(text)] = self._plan(len(text))
        own, masks, seen, found = letters(text), self.masks, set(), {}
        for k, index, places in plan:
            for start, end in places:
                for s in index.get(text[start:end], ()):
                    if s not in seen:
                        seen.add(s)
                        if (own ^ masks[s]).bit_count() <= 2 * k:
                            d = banded_distance(text, s, k)
                            if d <= k:
                                found[s] = d
        return found
