"""A 64-bit finaliser shared by the operators that hash integers."""

from __future__ import annotations

import numpy as np


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64's finaliser (one to one) of keys and seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
