"""Groups and components inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def sorted_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of equal ``key``; the rows come sorted by it."""
    pending: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        keys = columns[key]
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = {c: v[start:end] for c, v in columns.items()}
            if pending and pending[0][key][0] != part[key][0]:
                yield _joined(pending)
                pending = []
            pending.append(part)
    if pending:
        yield _joined(pending)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


class Forest:
    """Union-find over positions; roots are the smallest positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.parent))), np.int64, len(self.parent))
