"""The binary Golay code as a fuzzy hash of 23-bit words.

The code is perfect: every 23-bit word lies within 3 bits of exactly one of its 4096 codewords. The keys of a word are the
12-bit indices of the codewords that it and its 23 neighbours at one bit decode to: one key, or six. Two words that differ in at most
two bits have a common neighbour (or are neighbours), so they share a key.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code.
GENERATOR = 0b101011100011
LENGTH, CHECK = 23, 11
MOST_KEYS = 6


def _syndrome(word: np.ndarray) -> np.ndarray:
    word = word.astype(np.uint32).copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        word ^= np.where((word >> np.uint32(bit)) & np.uint32(1), np.uint32(GENERATOR << (bit - CHECK)), np.uint32(0))
    return word


@cache
def _decoder() -> np.ndarray:
    """For each of the 2^23 words, the index of its codeword (its 12 upper bits)."""
    bits = [1 << i for i in range(LENGTH)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    errors = np.array(errors, dtype=np.uint32)
    by_syndrome = np.zeros(1 << CHECK, dtype=np.uint32)
    by_syndrome[_syndrome(errors)] = errors
    words = np.arange(1 << LENGTH, dtype=np.uint32)
    return ((words ^ by_syndrome[_syndrome(words)]) >> np.uint32(CHECK)).astype(np.uint16)


def decode(word: np.ndarray) -> np.ndarray:
    return _decoder()[word]


def keys(word: np.ndarray) -> np.ndarray:
    """(len(word), MOST_KEYS) array of int32: the distinct keys of each word; unused places hold -1."""
    near = np.concatenate([decode(word)[:, None], *(decode(word ^ np.uint32(1 << b))[:, None] for b in range(LENGTH))], axis=1).astype(np.int32)
    near.sort(axis=1)
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.full((len(word), MOST_KEYS), -1, dtype=np.int32)
    row = np.nonzero(new)[0]
    out[row, place[new]] = near[new]
    return out
