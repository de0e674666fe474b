"""Binary fuse filters (Graf & Lemire, 2022) over 64-bit keys: three-way, with fingerprints of eight bits.

A filter takes about nine bits per key, never misses a key it was built from, and reports another one with
probability 1/256. It can't be changed once built. All steps work on whole arrays.
"""

from __future__ import annotations

import numpy as np

from marquee.llm.textarrays import U64, mix64

HEADER = np.dtype([("seed", "<u8"), ("segment", "<u4"), ("count", "<u4")])


def _shape(n: int) -> tuple[int, int]:
    """(segment length, number of segments that a first position can lie in) for n keys, by the paper's formulas."""
    segment = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(1, int(np.ceil(n * factor / segment)) - 2)


def _places(hashed: np.ndarray, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three positions in consecutive segments for each key, and its fingerprint."""
    mask = U64(segment - 1)
    first = ((hashed >> U64(32)) * U64(segment * count)) >> U64(32)
    places = np.stack([first, (first + U64(segment)) ^ ((hashed >> U64(18)) & mask), (first + U64(2 * segment)) ^ (hashed & mask)])
    return places.astype(np.int64), ((hashed ^ (hashed >> U64(29))) & U64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of these keys, which may repeat."""
    keys = np.unique(keys.astype(U64))
    segment, count = _shape(len(keys))
    size = segment * (count + 2)
    for seed in range(1, 1000):
        hashed = mix64(keys + mix64(np.array([seed], U64)))
        places, prints = _places(hashed, segment, count)
        left = np.zeros(size, np.int64)  # keys still at each position, and the sum of their numbers
        names = np.zeros(size, np.int64)
        for p in places:
            left += np.bincount(p, minlength=size)
            np.add.at(names, p, np.arange(len(keys)))
        order, ready = [], np.flatnonzero(left == 1)
        while len(ready):
            at, once = np.unique(names[ready], return_index=True)  # a key that is alone at two positions is taken at one
            spot = ready[once]
            order.append((at, spot))
            touched = places[:, at].ravel()
            np.subtract.at(left, touched, 1)
            np.subtract.at(names, touched, np.tile(at, 3))
            touched = np.unique(touched)
            ready = touched[left[touched] == 1]
        if sum(len(at) for at, _ in order) == len(keys):
            table = np.zeros(size, np.uint8)
            for at, spot in reversed(order):
                others = table[places[:, at]]
                table[spot] = prints[at] ^ others[0] ^ others[1] ^ others[2]  # the own place still holds 0
            return np.array([(seed, segment, count)], HEADER).tobytes() + table.tobytes()
    raise ValueError("no seed gives a filter")


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter."""
    seed, segment, count = np.frombuffer(blob, HEADER, 1)[0]
    table = np.frombuffer(blob, np.uint8, offset=HEADER.itemsize)
    places, prints = _places(mix64(keys.astype(U64) + mix64(np.array([seed], U64))), int(segment), int(count))
    return (table[places[0]] ^ table[places[1]] ^ table[places[2]]) == prints
