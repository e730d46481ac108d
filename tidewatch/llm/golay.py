"""The perfect binary Golay code of 23 bits, 12 of them free, as a fuzzy hash.

Every 23-bit value lies within three bits of exactly one codeword.  ``nearby`` gives the codewords that a value or any
value one bit away decodes to: one if the value lies within two bits of its codeword, else six.  Two values that differ
in at most two bits have a common neighbour one bit away from both, so they always share one of these codewords.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0xC75  # fixed: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
MOST = 6  # codewords near one value


def _remainder(x: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


_UNIT = np.array([_remainder(1 << i) for i in range(BITS)], dtype=np.int64)


def _sums(units: np.ndarray) -> np.ndarray:
    """Remainder of every value of as many bits as there are ``units``."""
    out = np.zeros(1, dtype=np.int64)
    for u in units:
        out = np.concatenate((out, out ^ u))
    return out


_LOW, _HIGH = _sums(_UNIT[:12]), _sums(_UNIT[12:])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the differences to the codewords nearby, padded with the first, and how many there are."""
    error = np.zeros(1 << 11, dtype=np.int64)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            pattern = sum(1 << p for p in places)
            error[_remainder(pattern)] = pattern
    near = np.zeros((1 << 11, MOST), dtype=np.int64)
    count = np.zeros(1 << 11, dtype=np.int64)
    for s in range(1 << 11):
        own = int(error[s])
        others = {1 << i ^ int(error[s ^ int(_UNIT[i])]) for i in range(BITS)} - {own}
        found = [own, *sorted(others)]
        count[s] = len(found)
        near[s] = found + [own] * (MOST - len(found))
    return near, count


_NEAR, _COUNT = _tables()


def remainders(values: np.ndarray) -> np.ndarray:
    """What division by the generator leaves of 23-bit values; zero for codewords."""
    values = values.astype(np.int64)
    return _LOW[values & 0xFFF] ^ _HIGH[values >> 12]


def nearby(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, index)``: for every value, by its row, the 12-bit indices of the codewords nearby."""
    values = values.astype(np.int64)
    rest = remainders(values)
    valid = np.arange(MOST) < _COUNT[rest][:, None]
    words = (values[:, None] ^ _NEAR[rest]) >> 11
    return np.nonzero(valid)[0], words[valid]
