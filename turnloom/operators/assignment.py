"""Optimal assignment on small cost matrices (shortest augmenting paths, O(n^3))."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the cheapest complete assignment of the shorter side; ties go to low indices."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        slack = cost[start] - row_price[start] - col_price
        via, done = np.full(m, start), np.zeros(m, bool)
        tree_rows, reached = [start], 0.0
        while True:
            free = np.where(done, np.inf, slack)
            col = int(np.argmin(free))
            reached = free[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = int(owner[col])
            tree_rows.append(row)
            better = reached + cost[row] - row_price[row] - col_price
            closer = ~done & (better < slack - 1e-15)
            slack[closer], via[closer] = better[closer], row
        # Prices move by how much earlier than the end each row and column was reached.
        for c in np.flatnonzero(done):
            if owner[c] >= 0 and c != col:
                row_price[owner[c]] += reached - slack[c]
                col_price[c] -= reached - slack[c]
        row_price[start] += reached
        while True:
            row = int(via[col])
            owner[col], col = row, int(np.flatnonzero(owner == row)[0]) if row != start else -1
            if col < 0:
                break
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)
