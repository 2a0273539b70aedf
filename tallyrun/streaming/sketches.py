"""Bounded states for features that ask for approx=True: distinct values, quantiles, most frequent values.

Each is exact while few values have come, small ever after, and can be merged, so windows keep one a bucket.
"""

from __future__ import annotations

import hashlib
import math
from typing import Any

from .folds import Fold, number


class DistinctSketch(Fold):
    """A set of up to `exact` values, then HyperLogLog registers; their relative error is 1.04 / sqrt(2^bits) = 1.6 %."""

    def __init__(self, exact: int = 1024, bits: int = 12):
        self.exact, self.bits = exact, bits
        self.seen: set[bytes] | None = set()
        self.registers = b""

    def add(self, t, v):
        if v is None:
            return
        h = hashlib.blake2b(f"{type(v).__name__}:{v}".encode(), digest_size=8).digest()
        if self.seen is None:
            own = bytearray(self.registers)
            self._raise(own, h)
            self.registers = bytes(own)
            return
        self.seen.add(h)
        if len(self.seen) > self.exact:
            self._spread()

    def _raise(self, registers: bytearray, h: bytes) -> None:
        x = int.from_bytes(h, "big")
        cell, rest = x >> (64 - self.bits), x & ((1 << (64 - self.bits)) - 1)
        registers[cell] = max(registers[cell], 64 - self.bits - rest.bit_length() + 1)

    def _spread(self) -> None:
        registers = bytearray(self.registers or bytes(1 << self.bits))
        for h in self.seen or ():
            self._raise(registers, h)
        self.seen, self.registers = None, bytes(registers)

    def merge(self, o):
        if self.seen is not None and o.seen is not None:
            self.seen |= o.seen
            if len(self.seen) > self.exact:
                self._spread()
            return
        if self.seen is not None:
            self._spread()
        own = bytearray(self.registers)
        if o.seen is not None:
            for h in o.seen:
                self._raise(own, h)
        else:
            own = bytearray(map(max, own, o.registers))
        self.registers = bytes(own)

    def value(self, now):
        if self.seen is not None:
            return len(self.seen)
        m = len(self.registers)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / sum(2.0**-r for r in self.registers)
        empty = self.registers.count(0)
        return round(m * math.log(m / empty) if raw <= 2.5 * m and empty else raw)


class QuantileSketch(Fold):
    """Counts in cells whose width grows with the value, so a quantile has a bounded relative error.

    The error is `error` until more than `most` cells are in use; then each two cells become one, which about doubles it.
    """

    def __init__(self, q: float, error: float = 0.005, most: int = 1024):
        self.q, self.most, self.n, self.zeros = q, most, 0, 0
        self.gamma = (1 + error) / (1 - error)
        self.cells: dict[tuple[int, int], int] = {}

    def add(self, t, v):
        x = number(v)
        if x is None or not math.isfinite(x):
            return
        self.n += 1
        if x == 0:
            self.zeros += 1
            return
        self._put((1 if x > 0 else -1, math.ceil(math.log(abs(x)) / math.log(self.gamma))), 1)
        self._shrink()

    def _put(self, cell, n):
        self.cells[cell] = self.cells.get(cell, 0) + n

    def _widen(self) -> None:
        """Cells of the squared width: cell k holds what cells 2k - 1 and 2k held."""
        old, self.cells = self.cells, {}
        self.gamma *= self.gamma
        for (sign, k), n in old.items():
            self._put((sign, -(-k // 2)), n)

    def _shrink(self) -> None:
        while len(self.cells) > self.most:
            self._widen()

    def merge(self, o):
        while self.gamma < o.gamma * (1 - 1e-9):
            self._widen()
        steps, gamma = 0, o.gamma
        while gamma < self.gamma * (1 - 1e-9):
            gamma *= gamma
            steps += 1
        for (sign, k), n in o.cells.items():
            for _ in range(steps):
                k = -(-k // 2)
            self._put((sign, k), n)
        self.n += o.n
        self.zeros += o.zeros
        self._shrink()

    def value(self, now):
        if not self.n:
            return None
        rank, got = self.q * (self.n - 1), 0
        ordered = sorted((sign * k, sign, n) for (sign, k), n in self.cells.items() if sign < 0)
        ordered += [(0, 0, self.zeros)] + sorted((k, sign, n) for (sign, k), n in self.cells.items() if sign > 0)
        for k, sign, n in ordered:
            got += n
            if n and got > rank:
                return 0.0 if not sign else sign * 2 * self.gamma ** (sign * k) / (self.gamma + 1)
        return None


class FrequentSketch(Fold):
    """Up to 2 x `most` counters; the smaller half goes when they are full, and a value that comes (again) later starts from what
    the largest of those had. So counts are never too low, and too high by `floor` at most."""

    def __init__(self, k: int, most: int = 1024):
        self.k, self.most, self.floor = k, max(most, 4 * k), 0
        self.counts: dict[Any, int] = {}

    def add(self, t, v):
        if v is not None and not isinstance(v, bytes):
            self.counts[v] = self.counts.get(v, self.floor) + 1
            self._shrink()

    def _shrink(self) -> None:
        if len(self.counts) > 2 * self.most:
            ordered = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))
            self.floor = max(self.floor, ordered[self.most][1])
            self.counts = dict(ordered[: self.most])

    def merge(self, o):
        self.counts = {v: self.counts.get(v, self.floor) + o.counts.get(v, o.floor) for v in {*self.counts, *o.counts}}
        self.floor += o.floor
        self._shrink()

    def value(self, now):
        best = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[: self.k]
        return [{"value": v, "count": n} for v, n in best]
