"""Matching one text against many: the matcher's table of the incoming text is made once, and bounds say which existing
texts it needn't be run against.

No bound changes a result. The matcher's blocks are a common subsequence of both texts, so a ratio is at most that of the
lengths, that of the characters which both have as often, and that of the longest common subsequence; each is
dearer and closer than the one before. (Shared q-grams of two and more characters bound nothing: blocks may be of one character.)
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from difflib import SequenceMatcher
from typing import Any

import numpy as np

#: Ratios of pairs of short texts that a task has seen; folds meet the same pairs again and again.
_SEEN: dict[tuple[str, str], float] = {}
SHORT, MOST_SEEN = 64, 200_000
#: Classes that characters are counted by; more would be closer, not more right.
CLASSES = 64


def ratio_of(matches: int, a: int, b: int) -> float:
    """As the matcher computes it."""
    return 2.0 * matches / (a + b) if a + b else 1.0


def length_bound(a: str, b: str) -> float:
    return ratio_of(min(len(a), len(b)), len(a), len(b))


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % CLASSES, minlength=CLASSES).astype(np.int32)


class Against:
    """An incoming text, and the ratios of existing texts to it (existing text first, with the matcher's popularity heuristic)."""

    runs = 0  # of the matcher, by all of the process

    def __init__(self, text: str) -> None:
        self.text, self._matcher, self._masks = text, None, None

    def ratio(self, existing: str) -> float:
        if existing == self.text:
            return 1.0
        short = len(existing) + len(self.text) <= 2 * SHORT
        if short and (known := _SEEN.get((existing, self.text))) is not None:
            return known
        if self._matcher is None:
            self._matcher = SequenceMatcher(None, "", self.text)
        self._matcher.set_seq1(existing)
        Against.runs += 1
        out = self._matcher.ratio()
        if short:
            if len(_SEEN) >= MOST_SEEN:
                _SEEN.clear()
            _SEEN[existing, self.text] = out
        return out

    def subsequence_bound(self, existing: str) -> float:
        """By the longest common subsequence, whose rows are the bits of one integer."""
        if self._masks is None:
            self._masks = {}
            for i, c in enumerate(self.text):
                self._masks[c] = self._masks.get(c, 0) | 1 << i
        full = (1 << len(self.text)) - 1
        zeros, masks = full, self._masks
        for c in existing:
            if hit := zeros & masks.get(c, 0):
                zeros = (zeros + hit | zeros - hit) & full
        return ratio_of(len(self.text) - zeros.bit_count(), len(existing), len(self.text))


class Texts:
    """The texts among an array's elements that nothing has replaced yet, by their places: of each text, of each
    length, and (once several have to be told apart) their counts of characters."""

    FEW = 8

    def __init__(self, elements: list[Any]) -> None:
        self.places: dict[str, list[int]] = {}
        self.lengths: list[tuple[int, int]] = []
        self.text: dict[int, str] = {}
        self.counts: np.ndarray | None = None
        for i, x in enumerate(elements):
            if isinstance(x, str):
                self._put(i, x)
        self.lengths.sort()

    def _put(self, place: int, text: str) -> None:
        self.text[place] = text
        self.places.setdefault(text, []).append(place)
        self.lengths.append((len(text), place))

    def add(self, place: int, text: str) -> None:
        """A text at the array's end."""
        self._put(place, text)
        insort(self.lengths, self.lengths.pop())
        if self.counts is not None:
            self._count(place, text)

    def _count(self, place: int, text: str) -> None:
        if place >= len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((place + 1, CLASSES), np.int32)])
        self.counts[place] = class_counts(text)

    def remove(self, place: int) -> None:
        text = self.text.pop(place)
        self.places[text].remove(place)
        del self.lengths[bisect_left(self.lengths, (len(text), place))]

    def _by_counts(self, near: list[tuple[int, int]], text: str, least: float) -> list[int]:
        """The places whose characters allow ``least``."""
        if self.counts is None:
            self.counts = np.zeros((max(self.text) + 1, CLASSES), np.int32)
            for place, own in self.text.items():
                self._count(place, own)
        sizes, places = np.array(near, np.int64).T
        bound = 2.0 * np.minimum(self.counts[places], class_counts(text)).sum(1) / np.maximum(sizes + len(text), 1)
        return places[(bound >= least) & (bound > 0)].tolist()

    def best(self, text: str, least: float) -> tuple[float, int | None]:
        """The greatest ratio of ``least`` or more, over 0, and the first place that has it; (0, None) without one."""
        if same := self.places.get(text):
            return 1.0, same[0]
        n = len(text)
        # A text of a characters is bounded by 2 min(a, n) / (a + n). One more on either side, as that is tested exactly below.
        low = bisect_left(self.lengths, (int(n * least / (2 - least)) - 1, -1)) if least < 2 else len(self.lengths)
        high = bisect_left(self.lengths, (int(n * (2 - least) / least) + 2, -1)) if least > 0 else len(self.lengths)
        near, against = self.lengths[low:high], Against(text)
        if len(near) <= self.FEW:
            places, bound = [place for _, place in near], lambda i: length_bound(self.text[i], text)
        else:
            places, bound = self._by_counts(near, text, least), lambda i: against.subsequence_bound(self.text[i])
        return first_of_best(places, bound, lambda i: against.ratio(self.text[i]), least)


def is_scalar(x: Any) -> bool:
    return not isinstance(x, (str, dict, list, set))


class Scalars:
    """The numbers, truth values, dates and nulls among an array's elements: equal ones are alike wholly, others not at all."""

    def __init__(self, elements: list[Any]) -> None:
        self.places: dict[tuple[type, Any], list[int]] = {}
        for i, x in enumerate(elements):
            self.add(i, x)

    def add(self, place: int, x: Any) -> None:
        if is_scalar(x) and x == x:
            self.places.setdefault((type(x), x), []).append(place)

    def remove(self, place: int, x: Any) -> None:
        self.places[type(x), x].remove(place)

    def best(self, x: Any) -> tuple[float, int | None]:
        same = self.places.get((type(x), x))
        return (1.0, same[0]) if same else (0.0, None)


def first_of_best(places: list[int], bound: Callable[[int], float], score: Callable[[int], float], least: float) -> tuple[float, int | None]:
    """The greatest score of ``least`` or more, over 0, and the first place that has it. ``bound`` is never under the score, so what it
    says is gone through from the top until it is under the best score; of equal scores the first place counts, so a bound that is as
    good as the best may still matter."""
    best, at = 0.0, None
    for most, minus in sorted(((bound(i), -i) for i in places), reverse=True):
        if most < max(best, least) or most <= 0:
            break
        if most == best and -minus > at:
            continue
        got = score(-minus)
        if got >= least and got > 0 and (got > best or (got == best and -minus < at)):
            best, at = got, -minus
    return best, at
