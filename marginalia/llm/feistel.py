"""A keyed permutation of 0..n-1 by an alternating Feistel network with cycle walking.

The domain is split as left + a * right with a = ceil(sqrt(n)) and b = ceil(n / a); rounds add a keyed hash of one half to the
other, modulo a or b in turn, so each round can be undone and the network permutes 0..a*b-1. a*b exceeds n by less than a;
a number that lands there is permuted again until it falls below n. Cycles are finite, so this ends, and the walk restricted
to 0..n-1 is a permutation of it.
"""

from __future__ import annotations

import math

import numpy as np

ROUNDS = 6
MASK = 0xFFFFFFFF
#: Multipliers of the round function.
MUL_1, MUL_2 = 2654435761, 2246822519


def split(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(key: int) -> list[int]:
    """One 32-bit number for each round, from a linear congruential sequence seeded by the key."""
    out, x = [], key & 0xFFFFFFFFFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append(x >> 32)
    return out


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    mask = np.uint64(MASK)
    x = (x * np.uint64(MUL_1) + np.uint64(k)) & mask
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(MUL_2)) & mask
    return x ^ (x >> np.uint64(13))


def _forward(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    ua, ub = np.uint64(a), np.uint64(b)
    left, right = x % ua, x // ua
    for j, k in enumerate(keys):
        if j % 2:
            right = (right + _mix(left, k) % ub) % ub
        else:
            left = (left + _mix(right, k) % ua) % ua
    return left + ua * right


def _backward(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    ua, ub = np.uint64(a), np.uint64(b)
    left, right = x % ua, x // ua
    for j, k in reversed(list(enumerate(keys))):
        if j % 2:
            right = (right + ub - _mix(left, k) % ub) % ub
        else:
            left = (left + ua - _mix(right, k) % ua) % ua
    return left + ua * right


def permute(x, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Images (or, if inverse, pre-images) of x, each in 0..n-1, for n below 2**62."""
    a, b = split(n)
    keys, step = round_keys(key), _backward if inverse else _forward
    out = step(np.asarray(x, dtype=np.uint64), a, b, keys)
    while (far := out >= np.uint64(n)).any():
        out[far] = step(out[far], a, b, keys)
    return out.astype(np.int64)
