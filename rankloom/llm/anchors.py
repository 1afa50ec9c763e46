"""Anchors: a thin set of places in which equal strings agree.

Every ``length`` consecutive units (bytes or words) hold at least one anchor,
chosen by their content alone: the place with the smallest gram hash among the
first ``window`` grams. So if a string of ``length`` units occurs twice, both
occurrences have an anchor at the same place in them, and the ``core`` units from
the anchor on lie inside both. Only anchors whose core occurs again can belong to
a repeated string, and of the text around an anchor only ``window - 1`` units to
the left of it and to the right of its core matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rankloom.llm.words import mixed

_PLACES = np.uint64(22)
_CHUNK = 1 << 19
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass(frozen=True)
class Scheme:
    length: int
    window: int
    gram: int

    def __post_init__(self):
        if self.window + self.gram - 1 > self.length or self.window > self.length:
            raise ValueError("the first grams must lie inside a string of the length")

    @property
    def core(self) -> int:
        return self.length - self.window + 1

    @property
    def side(self) -> int:
        return self.window - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Prints:
    """Fingerprints of stretches of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        power, self.back = _power(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def prefix_prints(units: np.ndarray) -> np.ndarray:
    """Running sums for the fingerprints of each row of a matrix of units."""
    power, _ = _power(units.shape[1] + 1)
    sums = np.zeros((units.shape[0], units.shape[1] + 1), np.uint64)
    np.cumsum(units * power[:-1], axis=1, out=sums[:, 1:])
    return sums


def stretch_prints(sums: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Of each of the given rows the fingerprint of ``length`` units from its own start on."""
    back = _power(sums.shape[1])[1][start]
    return mixed((sums[row, start + length] - sums[row, start]) * back + np.uint64(length))


def find(units: np.ndarray, prints: Prints, bounds: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Anchors of texts that lie one after the other; ``bounds`` are their ends, the first entry 0."""
    n = len(units)
    if n < scheme.length:
        return np.empty(0, np.int64)
    end_of = np.repeat(bounds[1:], np.diff(bounds))
    chosen = []
    for at in range(0, n - scheme.length + 1, _CHUNK):
        starts = np.arange(at, min(n - scheme.gram + 1, at + _CHUNK + scheme.window))
        key = (prints.of(starts, starts + scheme.gram) >> _PLACES << _PLACES) + (starts - at).astype(np.uint64)
        width = 1
        while width < scheme.window:
            step = min(width, scheme.window - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        places = (key & np.uint64((1 << int(_PLACES)) - 1)).astype(np.int64) + at
        # Only strings of the full length inside one text count.
        begin = starts[: len(places)]
        chosen.append(np.unique(places[begin + scheme.length <= end_of[begin]]))
    return np.unique(np.concatenate(chosen))
