"""Which texts share a run of k words with which patterns, and where: one numpy pass over a batch of texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from itertools import repeat

import numpy as np

_TOKEN = re.compile(r"[^\W_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _TOKEN.findall(text.lower()) if text else []


class Seeds:
    """The runs of k words of some patterns. Words are numbered from 1; 0 is any other word."""

    def __init__(self, patterns: Sequence[Sequence[str]], k: int):
        self.k = k
        self.vocabulary: dict[str, int] = {}
        self.patterns = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in p] for p in patterns]
        found = defaultdict(set)
        for n, line in enumerate(self.patterns):
            numbers = np.array(line, np.uint64)
            for value in self._hashes(numbers, np.arange(max(0, len(line) - k + 1))):
                found[int(value)].add(n)
        self.values = np.array(sorted(found), np.uint64)
        self.of = [sorted(found[int(v)]) for v in self.values]

    def _hashes(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        value = np.zeros(len(places), np.uint64)
        for j in range(self.k):
            value = value * _STEP + numbers[places + j]
            value ^= value >> np.uint64(29)
        return value

    def find(self, lines: Sequence[Sequence[str]]) -> tuple[list[np.ndarray], dict[tuple[int, int], list[int]]]:
        """Each text's word numbers, and for (text, pattern) the ascending starts of runs of k words that the pattern has too."""
        starts = np.cumsum([0, *(len(x) + 1 for x in lines)])
        joined = np.zeros(starts[-1] + self.k, np.int64)  # a 0 ends each text
        for at, line in zip(starts, lines, strict=False):
            joined[at : at + len(line)] = np.fromiter(map(self.vocabulary.get, line, repeat(0)), np.int64, len(line))
        numbered = [joined[a : b - 1] for a, b in zip(starts, starts[1:], strict=False)]
        out: dict[tuple[int, int], list[int]] = defaultdict(list)
        if len(self.values):
            known = np.concatenate([[0], np.cumsum(joined != 0)])
            places = np.nonzero(known[self.k :] - known[: -self.k] == self.k)[0]
            value = self._hashes(joined.astype(np.uint64), places)
            which = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            hit = self.values[which] == value
            text = np.searchsorted(starts, places[hit], side="right") - 1
            for at, seed, n in zip((places[hit] - starts[text]).tolist(), which[hit].tolist(), text.tolist(), strict=True):
                for pattern in self.of[seed]:
                    out[n, pattern].append(at)
        return numbered, out
