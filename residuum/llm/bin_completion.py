"""Bin completion: few bins for many items of few sizes.

An instance is a histogram: for each size the number of items.  A solution is a
list of ``(pattern, times)``; a pattern lists ``(size, copies)`` of one bin.  So
the work hangs on the number of sizes (at most the capacity), not on the number
of items.

The search takes the largest item left, enumerates the undominated fillings of
the rest of its bin and branches over them.  A filling is dominated when some of
its items can be replaced by one larger item that still fits: what they leave
free can be placed wherever that item would have gone.  A branch is cut when the
waste of its bins, or the bound on what is left, rules out fewer bins than the
best solution known, which is best-fit decreasing at first.  A filling is used
as often as the items last, or once; the second choice keeps the search
complete.  The search ends at the lower bound, when all branches are done, or
after ``nodes`` steps with the best solution known.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Mapping

import numpy as np

Pattern = tuple[tuple[int, int], ...]

#: Steps of the search: bins or groups of equal bins placed.
NODES = 20_000
#: Fillings kept of one bin, and partial fillings looked at for them.
WIDTH, STEPS = 12, 400


def bins_of(solution: list[tuple[Pattern, int]]) -> int:
    return sum(times for _, times in solution)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No solution has fewer bins.  For each threshold t: items above
    capacity - t and items above half stand alone, and of the others those of at
    least t must go into the room left or into bins of their own."""
    sizes = np.arange(capacity + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    t = np.concatenate([[0], np.flatnonzero(counts[:half + 1])])
    alone = number[capacity] - number[capacity - t]
    paired = number[capacity - t] - number[half]
    room = paired * capacity - (mass[capacity - t] - mass[half])
    small = mass[half] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    return int(np.max(alone + paired + np.maximum(0, -((room - small) // capacity)), initial=0))


def best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the histogram: each item goes to the fullest bin
    that has room for it.  Equal bins are placed together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, times))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, pattern, times = capacity, (), left
            else:
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            fit = room // size
            full = min(times, left // fit)
            if full:
                put(room - fit * size, (*pattern, (size, fit)), full)
                left -= full * fit
            else:
                put(room - left * size, (*pattern, (size, left)), 1)
                full, left = 1, 0
            if pattern:
                put(room, pattern, times - full)
    return [g for room in rooms for g in groups[room]]


def _multiple_sums(items: list[int], most: int) -> tuple[int, int]:
    """The sums of at least two of the items, and of exactly one, as bits."""
    none, one, more = 1, 0, 0
    mask = (1 << (most + 1)) - 1
    for x in items:
        more = (more | (more << x) | (one << x)) & mask
        one |= none << x
    return more, one


def is_dominated(items: list[int], spare: int, others: int, room: int) -> bool:
    """Whether several of the items, or one, can be replaced by one larger item
    among ``others`` (sizes as bits) within ``spare`` units of waste; several
    items are also dominated by one of the same size as all of them."""
    more, one = _multiple_sums(items, room)
    wide, larger = others, 0
    for d in range(1, spare + 1):
        wide |= others >> d
        larger |= others >> d
    return bool(more & wide or one & larger)


def fillings(room: int, counts: list[int], sizes: int, spare: int, width: int = WIDTH, steps: int = STEPS) -> list[list[int]]:
    """Undominated maximal fillings of ``room`` that waste at most ``spare``,
    least waste first, then fewest items.  ``sizes`` has a bit for each size with
    items left.  At most ``steps`` partial fillings are looked at."""
    found: list[tuple[int, int, list[int]]] = []
    taken: Counter[int] = Counter()
    chosen: list[int] = []
    budget = steps

    def left_of(sizes: int) -> int:
        for x, n in taken.items():
            if n and counts[x] <= n:
                sizes &= ~(1 << x)
        return sizes

    def grow(room: int, top: int) -> None:
        nonlocal budget
        budget -= 1
        fit = left_of(sizes) & ((1 << (room + 1)) - 1)
        if not fit:
            if room <= spare:
                found.append((room, len(chosen), chosen.copy()))
            return
        fit &= (1 << (top + 1)) - 1
        while fit and budget > 0 and len(found) < 4 * width:
            x = fit.bit_length() - 1
            fit &= ~(1 << x)
            taken[x] += 1
            chosen.append(x)
            grow(room - x, x)
            chosen.pop()
            taken[x] -= 1

    grow(room, room)
    found.sort(key=lambda f: (f[0], f[1], [-x for x in f[2]]))
    out = []
    for waste, _, items in found:
        others = sizes
        for x, n in Counter(items).items():
            if counts[x] <= n:
                others &= ~(1 << x)
        if not is_dominated(items, waste, others, room):
            out.append(items)
            if len(out) == width:
                break
    return out


def complete(histogram: Mapping[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """As few bins as the search finds; sizes are from 1 to ``capacity``."""
    if any(not 1 <= s <= capacity for s, n in histogram.items() if n):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    best = best_fit(histogram, capacity)
    counts = [0] * (capacity + 1)
    for s, n in histogram.items():
        counts[s] = n
    total = sum(s * n for s, n in enumerate(counts))
    floor = lower_bound(np.array(counts, np.int64), capacity)
    path: list[tuple[list[int], int]] = []  # items of the bin, times
    used = waste = 0
    sizes = sum(1 << s for s, n in enumerate(counts) if n)

    def place(items: list[int], times: int, sign: int) -> None:
        nonlocal used, waste, sizes
        for x in items:
            counts[x] -= sign * times
        for x in items:
            sizes = sizes | (1 << x) if counts[x] else sizes & ~(1 << x)
        used += sign * times
        waste += sign * times * (capacity - sum(items))

    def choices() -> list[tuple[list[int], int]]:
        """The next bins to try, the last one first."""
        allowed = (bins_of(best) - 1) * capacity - total - waste
        if allowed < 0 or used + lower_bound(np.array(counts, np.int64), capacity) >= bins_of(best):
            return []
        largest = sizes.bit_length() - 1
        counts[largest] -= 1
        rest = sizes if counts[largest] else sizes & ~(1 << largest)
        found = fillings(capacity - largest, counts, rest, min(allowed, capacity - largest))
        counts[largest] += 1
        out = []
        for items in found:
            whole = [largest, *items]
            times = min(counts[x] // n for x, n in Counter(whole).items())
            spared = capacity - sum(whole)
            times = min(times, allowed // spared) if spared else times
            out += [(whole, times)] if times <= 1 else [(whole, times), (whole, 1)]
        return out[::-1]

    open_: list[list[tuple[list[int], int]]] = [choices()] if sizes and bins_of(best) > floor else []
    while open_ and nodes > 0:
        if not open_[-1]:
            open_.pop()
            if path:
                items, times = path.pop()
                place(items, times, -1)
            continue
        items, times = open_[-1].pop()
        nodes -= 1
        place(items, times, 1)
        path.append((items, times))
        if not sizes:
            if used < bins_of(best):
                best = [(tuple(sorted(Counter(i).items(), reverse=True)), t) for i, t in path]
                if used == floor:
                    break
            open_.append([])
        else:
            open_.append(choices())
    return best
