"""Places of integer vectors along a Hilbert curve, as byte strings that sort in the curve's order."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> list[bytes]:
    """Keys of ``points`` (rows x dimensions, below 2**bits): after the exchanges and inversions that follow the curve
    through its cells, the bits of all dimensions, the highest of each first."""
    x = points.T.astype(np.uint32).copy()
    if not x.size:
        return [b""] * len(points)
    first = x[0]
    for b in range(bits - 1, 0, -1):
        high, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for row in x:
            swap = (first ^ row) & low & ~-((row & high) >> np.uint32(b))
            inverted = -((row & high) >> np.uint32(b)) & low
            row ^= swap
            first ^= swap | inverted
    for i in range(1, len(x)):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(first)
    for b in range(bits - 1, 0, -1):
        turn ^= -((x[-1] >> np.uint32(b)) & np.uint32(1)) & np.uint32((1 << b) - 1)
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]
