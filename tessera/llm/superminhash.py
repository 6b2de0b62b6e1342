"""SuperMinHash signatures of hashed sets, computed for many sets at once.

Element d draws, for step j = 0, 1, ..., a fraction r and a slot p_j of its own random permutation (a partial
Fisher-Yates shuffle); slot p_j keeps the minimum of r + j over all elements. The values of step j are at
least j, so a set is finished as soon as all its slots hold less than j + 1: long sets need few steps.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.kit import GOLDEN, mix

#: Elements worked on at a time; bounds the memory of the permutations (this many times m bytes).
CHUNK = 65_536


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """The (sets, m) signature matrix; elements are distinct within an owner. Sets without elements stay infinite."""
    if not 1 <= m <= 256:
        raise ValueError("m must be from 1 to 256")
    h = np.full(sets * m, np.inf)
    for at in range(0, len(elements), CHUNK):
        _lower(h, elements[at : at + CHUNK], owner[at : at + CHUNK], m)
    return h.reshape(sets, m)


def _lower(h: np.ndarray, x: np.ndarray, owner: np.ndarray, m: int) -> None:
    ranks = np.tile(np.arange(m, dtype=np.uint8), len(x))
    base = np.arange(len(x), dtype=np.int64) * m
    first = int(owner[0]) if len(owner) else 0
    table = h.reshape(-1, m)
    for j in range(m):
        z = mix(x + np.uint64((2 * j + 1) * int(GOLDEN) & (1 << 64) - 1))
        k = base + j + ((z & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
        slot = ranks[k]
        ranks[k] = ranks[base + j]
        np.minimum.at(h, owner * m + slot, (z >> np.uint64(24)).astype(np.float64) * 2.0**-40 + j)
        open_ = table[first : int(owner[-1]) + 1].max(axis=1) >= j + 1
        if not open_.all():
            stay = open_[owner - first]
            x, owner, base = x[stay], owner[stay], base[stay]
            if not len(x):
                return
            # first stays: owners are ascending, so the slice above still covers them


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, m // rows) bucket keys as signed 64-bit numbers; rows consecutive slots make a band."""
    bits = np.ascontiguousarray(signature).view(np.uint64)
    count = signature.shape[1] // rows
    keys = np.empty((len(signature), count), np.uint64)
    for b in range(count):
        key = np.full(len(signature), np.uint64(b), np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = mix(key + bits[:, i] + GOLDEN)
        keys[:, b] = key
    return keys.view(np.int64)
