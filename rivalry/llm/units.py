"""Encode texts through their distinct units.

A tokenizer whose pieces never cross the border before a single space gives a
text the ids of its units, one after another. Words repeat far more often than
texts, so each process encodes a unit once and keeps its ids; the store is
bounded, and units beyond it are encoded again in each batch."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from itertools import repeat

import numpy as np


def process_memo(kind: str, key, make: Callable):
    """``make()`` once per Python process, as workers serve many tasks. Only
    the latest ``key`` of a kind is kept."""
    store = sys.modules.setdefault("_llm_process_memo", types.ModuleType("_llm_process_memo")).__dict__
    if kind not in store or store[kind][0] != key:
        store.pop(kind, None)
        store[kind] = (key, make())
    return store[kind][1]


class UnitStore:
    """Ids of units. ``encode(units)`` returns (lengths, flat ids)."""

    def __init__(self, encode: Callable, bound: int = 1_000_000):
        self.encode, self.bound = encode, bound
        self.code: dict = {}
        self.length = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def _room(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def ids(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids per unit, all ids in order) of a list of units."""
        code = np.fromiter(map(self.code.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(code < 0)
        kept, used = len(self.code), self.used
        keep = True
        if len(missing):
            new = dict.fromkeys(units[i] for i in missing)
            lengths, flat = self.encode(list(new))
            n = len(new)
            self._room("length", kept + n)
            self._room("start", kept + n)
            self._room("flat", used + len(flat))
            self.length[kept: kept + n] = lengths
            self.start[kept: kept + n] = used + np.cumsum(lengths) - lengths
            self.flat[used: used + len(flat)] = flat
            for k, unit in enumerate(new):
                new[unit] = kept + k
            code[missing] = [new[units[i]] for i in missing]
            keep = kept + n <= self.bound
            if keep:
                self.code.update(new)
                self.used = used + len(flat)
        lengths = self.length[code]
        total = int(lengths.sum())
        before = np.cumsum(lengths) - lengths
        return lengths, self.flat[np.repeat(self.start[code] - before, lengths) + np.arange(total)]
