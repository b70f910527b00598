"""Ids of text units, remembered in two generations so that memory stays bounded and frequent units stay known."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

#: Units of one generation; the unit that exceeds it starts the next one.
GENERATION = 400_000

#: Units in an order of the learner's own, their ids one after the other, and the number of ids of each.
Learnt = tuple[list, np.ndarray, np.ndarray]


class _Generation:
    def __init__(self):
        self.index: dict = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, units: list, flat: np.ndarray, counts: np.ndarray) -> None:
        assert len(counts) == len(units)
        total, n = len(flat), len(self.index)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(units) > len(self.start):
            for name in ("start", "count"):
                value = getattr(self, name)
                setattr(self, name, np.concatenate([value, np.zeros_like(value)]))
        self.flat[self.used:self.used + total] = flat
        self.start[n:n + len(units)] = self.used + np.cumsum(counts) - counts
        self.count[n:n + len(units)] = counts
        self.used += total
        self.index.update(zip(units, range(n, n + len(units)), strict=True))

    def places(self, units: list) -> np.ndarray:
        """Where units are stored, -1 for unknown ones."""
        return np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids stored at some places one after the other, and the number of ids of each."""
        counts = self.count[places]
        source = np.repeat(self.start[places] - (np.cumsum(counts) - counts), counts)
        source += np.arange(len(source))
        return self.flat[source], counts


class UnitIds:
    """``of(units)``: ids of units; unknown ones are learnt together, each once.

    A full generation becomes the old one.  What is met again moves over to the
    new one, the rest goes with the old one, so units seen once do not drive
    out the frequent ones.
    """

    def __init__(self, learn: Callable[[list], Learnt], generation: int = GENERATION):
        self.learn, self.generation = learn, generation
        self.young, self.old = _Generation(), _Generation()

    def of(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after the other, and the number of ids of each."""
        if len(self.young.index) > self.generation:
            self.young, self.old = _Generation(), self.young
        places = self.young.places(units)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            asked = [units[k] for k in missing.tolist()]
            unseen = list(dict.fromkeys(asked))
            before = self.old.places(unseen)
            if len(again := np.flatnonzero(before >= 0)):
                self.young.add([unseen[k] for k in again.tolist()], *self.old.at(before[again]))
            if len(new := np.flatnonzero(before < 0)):
                self.young.add(*self.learn([unseen[k] for k in new.tolist()]))
            places[missing] = self.young.places(asked)
        return self.young.at(places)
