"""Merging of links into components inside one task, on arrays."""

from __future__ import annotations

import numpy as np


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join items a[i] and b[i]; afterwards root[i] is the least item of i's component. Changes root."""
    while a.size:
        left, right = root[a], root[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up
