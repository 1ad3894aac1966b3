"""The cutting-stock problem: a linear program over patterns, solved by column generation.

A pattern says how many items of each size share one bin. The program covers the demand for every size with as few
bins as possible. It starts from patterns of a single size; its dual prices go to a knapsack, solved by dynamic
programming, whose best filling is the next pattern. The work depends on the number of sizes, not on the demand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Pattern:
    """``times`` bins that each hold counts[i] items of sizes[i]."""

    sizes: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def best_filling(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of one bin with the largest sum of prices: its value, and the items of each size."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by_size, price = sizes[order], prices[order]
    fits = np.searchsorted(by_size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        if fits[room]:
            values = best[room - by_size[: fits[room]]] + price[: fits[room]]
            at = int(values.argmax())
            if values[at] > best[room] + 1e-12:
                best[room], choice[room] = values[at], at
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[order[choice[room]]] += 1
            room -= by_size[choice[room]]
    return float(best[capacity]), counts


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, most: int = 20_000):
    """The linear program's solution as (patterns, bins of each): one column for each size.

    Stops when the bound from the knapsack says that at most a share ``gap`` of the bins could still be saved.
    """
    m = len(sizes)
    each = capacity // sizes
    columns = np.diag(each.astype(float))
    inverse = np.diag(1.0 / each)
    amount = demand / each
    for _ in range(most):
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = best_filling(prices, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        rising = direction > 1e-9
        if not rising.any():
            break
        ratios = np.full(m, np.inf)
        ratios[rising] = amount[rising] / direction[rising]
        leaves = int(ratios.argmin())
        step = ratios[leaves]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[leaves] = step
        pivot = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
        columns[:, leaves] = pattern
    return columns, amount


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins for single items, largest first, each into the fullest bin that takes it."""
    by_room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    out = []
    for size in sorted(sizes, reverse=True):
        room = next((r for r in range(size, capacity + 1) if by_room[r]), None)
        if room is None:
            held: list[int] = []
            out.append(held)
            room = capacity
        else:
            held = by_room[room].pop()
        held.append(size)
        by_room[room - size].append(held)
    return out


def plan(demand: dict[int, int], capacity: int, gap: float = 2e-4) -> list[Pattern]:
    """Patterns that together hold exactly ``demand`` (size: number of items), in nearly as few bins as can be.

    The program's bins are rounded down. What that leaves, at most one filling for each size, is packed item by item.
    """
    wanted = {s: n for s, n in sorted(demand.items()) if n > 0}
    if not wanted:
        return []
    if min(wanted) < 1 or max(wanted) > capacity:
        raise ValueError("sizes lie between 1 and the capacity")
    sizes = np.array(list(wanted))
    left = np.array(list(wanted.values()), dtype=np.int64)
    out = []
    columns, amount = relaxed(sizes, left.astype(float), capacity, gap)
    for j in np.argsort(-amount):
        counts = columns[:, j].astype(np.int64)
        used = counts > 0
        times = int(min(np.floor(amount[j] + 1e-7), (left[used] // counts[used]).min(initial=np.iinfo(np.int64).max)))
        if times > 0 and used.any():
            left -= times * counts
            out.append(Pattern(tuple(sizes[used].tolist()), tuple(counts[used].tolist()), times))
    for held in best_fit(np.repeat(sizes, left).tolist(), capacity):
        kinds, counts = np.unique(held, return_counts=True)
        out.append(Pattern(tuple(kinds.tolist()), tuple(counts.tolist()), 1))
    return out
