"""Content-defined cuts by a rolling gear hash with normalised chunk sizes."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash

#: One fixed 32-bit number per byte value, made by a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
WINDOW = 32


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the (up to) `WINDOW` bytes that end there.

    The sum over j of GEAR[byte j back] << j is doubled in width at each step.
    """
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step)
        h, step = wider, 2 * step
    return h


def cuts(raw: bytes, least: int, normal: int, most: int) -> list[int]:
    """Ends of the chunks of `raw`, ascending; the last is len(raw). Empty bytes: none.

    A chunk ends where the hash is small: below `normal` bytes twice as rare as usual,
    above it twice as frequent; it has `least` to `most` bytes (the last one may be shorter).
    """
    n = len(raw)
    if n <= least:
        return [n] if n else []
    h = rolling(np.frombuffer(raw, np.uint8))
    loose = np.flatnonzero(h < np.uint32((1 << 32) * 2 // normal)) + 1
    strict = loose[h[loose - 1] < np.uint32((1 << 32) // (2 * normal))].tolist()
    loose = loose.tolist()
    found, start = [], 0
    while n - start > least:
        end = min(start + most, n)
        k = bisect_left(strict, start + least)
        if k < len(strict) and strict[k] < start + normal:
            end = min(strict[k], end)
        else:
            k = bisect_left(loose, start + normal)
            if k < len(loose):
                end = min(loose[k], end)
        found.append(end)
        start = end
    if start < n:
        found.append(n)
    return found
