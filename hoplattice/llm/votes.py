"""Signed bit votes over many hashed features at once, the core of every SimHash here."""

from __future__ import annotations

import numpy as np

#: Row b: the eight bits of byte value b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def ones(group: np.ndarray, hashes: np.ndarray, n_groups: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Weight with which each of 64 bits is set in the hashes of each group.

    A histogram of byte values per group and byte position, times the bits of
    each byte value: eight passes over the features instead of sixty-four.
    """
    as_bytes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    out = np.empty((n_groups, 64))
    base = group.astype(np.int64) * 256
    for k in range(8):
        histogram = np.bincount(base + as_bytes[:, k], weights=weights, minlength=n_groups * 256)
        out[:, 8 * k : 8 * k + 8] = histogram.reshape(n_groups, 256) @ _BITS
    return out


def majority(set_weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 where it is set in over half of the total weight."""
    bits = (2 * set_weight > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)
