"""Rolling hashes and content-chosen anchors over one long array that holds many documents.

A window of ``length`` units is named by its anchor: the leftmost seed (``seed`` consecutive units) with
the smallest hash inside it. Equal windows have their anchors at the same offset, so windows can only be
equal within the group of anchors that share a seed. Anchors never move backwards, so the windows of one
anchor are neighbours, and a document has about two anchors for each ``length - seed`` units.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
# Positions take the low half of a key. That is room for any text; hashes that agree in their high half go by position.
MAX_UNITS = 1 << 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    x ^= x >> np.uint64(27)
    x *= _ODD
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any stretch of an array from prefix sums of a polynomial modulo 2**64.

    Two instances with different ``salt`` are independent. Such polynomials can be fooled by stretches of a thousand units and
    more, whatever their base; those taken here stay below 500, and words, which may have any length, become units by ``word_units``.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, units: np.ndarray, salt: int) -> None:
        forward, self._backward = self._table(len(units) + 1, salt)
        self._sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * forward[: len(units)], out=self._sums[1:])
        self._salt = np.uint64(salt * 2 + 1)

    @classmethod
    def _table(cls, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(salt)
        if known is None or len(known[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            base = int(mixed(np.array([salt + 1], np.uint64))[0]) | 5
            base = base & ~2  # 1 modulo 4, so that powers have the longest period
            tables = []
            for step in (base, pow(base, -1, 1 << 64)):
                powers = np.full(size, np.uint64(step))
                powers[0] = 1
                tables.append(np.cumprod(powers))
            known = cls._powers[salt] = (tables[0], tables[1])
        return known

    def at(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        found = (self._sums[starts + lengths] - self._sums[starts]) * self._backward[starts]
        if np.ndim(lengths):
            return mixed(found + (lengths.astype(np.uint64) * _ODD + self._salt))
        return mixed(found + np.uint64((int(lengths) * int(_ODD) + int(self._salt)) % (1 << 64)))

    def every(self, length: int) -> np.ndarray:
        """The hash at each start that leaves room for ``length`` units."""
        found = (self._sums[length:] - self._sums[:-length]) * self._backward[: len(self._sums) - length]
        return mixed(found + np.uint64((length * int(_ODD) + int(self._salt)) % (1 << 64)))


def byte_units(data: np.ndarray, salt: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * salt + 3))[data]


_MASK = np.array([(1 << 8 * kept) - 1 for kept in range(9)], np.uint64)


def word_units(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *salts: int) -> list[np.ndarray]:
    """A hash of the bytes of every word, for each salt: eight bytes at a time are mixed into what came before.

    A step is a bijection of its eight bytes, so words that differ in one step only never collide, and no word can be built to
    cancel a difference, as is possible with polynomials.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    outs = [mixed(sizes.astype(np.uint64) + np.uint64(salt << 40)) for salt in salts]
    left, at, active = sizes, starts, None
    while len(at):
        block = eights[at] & _MASK[np.minimum(left, 8)]
        for out in outs:
            if active is None:
                out[:] = mixed(out ^ block)
            else:
                out[active] = mixed(out[active] ^ block)
        more = np.flatnonzero(left > 8)
        active = more if active is None else active[more]
        left, at = left[more] - 8, at[more] + 8
    return outs


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def anchors(seeds: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of every anchor; ``ends`` closes each document.

    ``seeds`` has the seed hash at each unit; windows that reach over an end are left out.
    """
    n = int(ends[-1]) if len(ends) else 0
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    if n > MAX_UNITS:
        raise ValueError("too many units in one array")
    low = np.uint64(MAX_UNITS - 1)
    keys = (seeds[: n - seed + 1] & ~low) | np.arange(n - seed + 1, dtype=np.uint64)
    place = (sliding_min(keys, length - seed + 1) & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    rooms = np.maximum(ends - starts - length + 1, 0)
    keep = np.zeros(len(place) + 1, np.int32)
    some = rooms > 0
    keep[starts[some]] += 1
    np.subtract.at(keep, starts[some] + rooms[some], 1)
    windows = np.flatnonzero(np.cumsum(keep[:-1]))
    place = place[windows]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])) if len(windows) else none
    last = np.concatenate([new[1:], [len(windows)]]) - 1 if len(windows) else none
    return place[new], windows[new], windows[last]


def covered(n: int, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in a stretch [first, last)."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, firsts, 1)
    np.subtract.at(marks, lasts, 1)
    return np.cumsum(marks[:-1]) > 0
