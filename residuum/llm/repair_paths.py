"""Cheapest edit scripts of role sequences, least first, by prefix doubling.

A sequence is repaired row by row.  Between rows the repaired part is in one of
four states: empty, after the system row, after a user row, after an assistant
row.  Edits are arcs between (position, state) nodes: Delete, Insert, Keep and
Rerole, each with its initial as label.  Many segments of sequences are worked
on together, as arrays:

1. costs: the min-plus product of the rows' 4 x 4 matrices from every position
   to the end of its segment, by doubling the stretch;
2. the arcs on cheapest paths are the nodes of a second graph.  Their rank by
   the first label is known; the rank by the next power of two labels is that of
   the pair (own rank, rank of the arc that the pointer of the last round
   reaches), and pointers double along;
3. of the arcs that leave a start the one of least rank is taken, and the script
   is read through the doubled pointers, longest jump first.

No two arcs of a node share a label, so the successor of least rank is unique.
A segment that is not the last of its sequence ends in the costs to go of the
next one; its paths are found for every state it may be entered in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Initials of roles by code; any other is 3.
KINDS = "sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Edits in the order of their initials, and their costs.
LABELS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE = range(4)
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
NEVER = 1 << 40

#: The state after one more user or assistant row.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by state and kind of role; -1: not allowed.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Costs to the end of the sequence after its last row.
AT_END = np.array([0, 2 * COST[INSERT], COST[INSERT], 0])
#: Adjacent kinds that are in order: system-user, user-assistant, assistant-user.
IN_ORDER = np.zeros((4, 4), bool)
IN_ORDER[0, 1] = IN_ORDER[1, 2] = IN_ORDER[2, 1] = True


def code(kind, fault):
    """One byte for a row: kind of role and fault."""
    return kind + 4 * fault


def edit_costs(codes: np.ndarray) -> np.ndarray:
    """Costs of Keep and Rerole by row (columns), ``NEVER`` where not allowed."""
    fault = codes >> 2
    extra = np.where((fault == BLANK) | (fault == DUPLICATE), NEVER, np.where(fault == TRUNCATED, TRUNCATED_COST, 0))
    return np.stack([COST[KEEP] + extra, COST[REROLE] + extra], 1).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :, 0, None] + b[:, 0, None, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return np.minimum(out, NEVER)


def _inserts() -> np.ndarray:
    """Costs of any number of inserts from state to state."""
    m = np.full((4, 4), NEVER)
    for q in range(4):
        m[q, q], r = 0, NEXT[q]
        m[q, r] = min(m[q, r], COST[INSERT])
        m[q, NEXT[r]] = min(m[q, NEXT[r]], 2 * COST[INSERT])
    return m


def row_matrices(codes: np.ndarray) -> np.ndarray:
    """Costs of a row from state to state, inserts before it included."""
    keep, rerole = edit_costs(codes).T
    m = np.full((len(codes), 4, 4), NEVER, np.int64)
    rows = np.arange(len(codes))
    for q in range(4):
        m[:, q, q] = COST[DELETE]
        m[rows, q, NEXT[q]] = np.minimum(m[rows, q, NEXT[q]], rerole)
        to = KEPT[q][codes & 3]
        ok = to >= 0
        m[rows[ok], q, to[ok]] = np.minimum(m[rows[ok], q, to[ok]], keep[ok])
    return _product(np.broadcast_to(_inserts(), m.shape), m)


def suffix_matrices(codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """For every row the costs from before it to the end of its segment."""
    m = row_matrices(codes)
    ends = np.repeat(borders[1:], np.diff(borders))
    rows, span = np.arange(len(codes)), 1
    while True:
        more = np.flatnonzero(rows + span < ends)
        if not len(more):
            return m
        m[more] = _product(m[more], m[more + span])
        span *= 2


def segment_matrices(codes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The costs of whole segments, of one row at least each."""
    return suffix_matrices(codes, borders)[borders[:-1]]


def through(matrix: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Costs to go before a stretch from those after it."""
    return np.minimum((matrix + costs).min(-1), NEVER)


@dataclass
class Paths:
    """By segment and state of entry: the script, the state at the end, the costs."""

    scripts: list[list[str | None]]
    exits: np.ndarray
    costs: np.ndarray


def least_paths(codes: np.ndarray, borders: np.ndarray, at_end: np.ndarray, last: np.ndarray, entries: np.ndarray) -> Paths:
    """Least scripts of segments that begin and end at ``borders``; ``at_end``
    has the costs to go after each, ``last`` says which end a sequence, and
    ``entries`` (segment x state) which starts are wanted."""
    sizes = np.diff(borders)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    end_position = borders[1:] + np.arange(len(sizes))
    is_end = np.zeros(len(segment), bool)
    is_end[end_position] = True
    row_of = np.cumsum(~is_end) - (~is_end)  # the row after a position
    # costs to go of every node
    togo = np.empty((len(segment), 4), np.int64)
    togo[is_end] = at_end
    if len(codes):
        suffix = suffix_matrices(codes, borders)
        togo[~is_end] = through(suffix, np.repeat(at_end, sizes, axis=0)[:, None, :])
    # arcs on cheapest paths
    keep_rerole = edit_costs(codes)
    inner, row = np.flatnonzero(~is_end), row_of[~is_end]
    open_end = np.flatnonzero(is_end)[last]
    arcs = []
    for q in range(4):
        r = NEXT[q]
        at = np.concatenate([inner, open_end])
        arcs.append((at, q, at, np.full(len(at), r), INSERT, np.full(len(at), COST[INSERT])))
        arcs.append((inner, q, inner + 1, np.full(len(inner), q), DELETE, np.full(len(inner), COST[DELETE])))
        arcs.append((inner, q, inner + 1, np.full(len(inner), r), REROLE, keep_rerole[row, 1]))
        to = KEPT[q][codes[row] & 3]
        ok = to >= 0
        arcs.append((inner[ok], q, inner[ok] + 1, to[ok], KEEP, keep_rerole[row[ok], 0]))
    source, target, label = [], [], []
    for at, q, to, state, edit, cost in arcs:
        cheapest = (togo[at, q] == cost + togo[to, state]) & (togo[at, q] < NEVER)
        source.append(at[cheapest] * 4 + q)
        target.append(to[cheapest] * 4 + state[cheapest])
        label.append(np.full(int(cheapest.sum()), edit))
    source, target, label = map(np.concatenate, (source, target, label))
    # the least successor of each node, by the rank of one label
    nodes = 4 * len(segment)
    n = len(source)

    def least(rank: np.ndarray) -> np.ndarray:
        order = np.lexsort((rank[:n], source))
        heads = order[np.concatenate([[True], np.diff(source[order]) > 0])] if n else order
        out = np.full(nodes, -1)
        out[source[heads]] = heads
        return out

    first = least(label)
    # where no arc leaves, a path ends: one end for each state, before all labels
    pointer = np.concatenate([np.where(first[target] >= 0, first[target], n + target % 4), n + np.arange(4)])
    rank = np.concatenate([label + 1, np.zeros(4, np.int64)])
    length = np.concatenate([np.ones(n, np.int64), np.zeros(4, np.int64)])
    pointers = []
    while True:
        pointers.append(pointer)
        if (pointer >= n).all():
            break
        length = length + length[pointer]
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
    # starts: of the arcs that leave each wanted node the one of least rank
    which, state = np.nonzero(entries)
    node = (borders[:-1] + np.arange(len(sizes)))[which] * 4 + state
    start = least(rank)[node]
    start = np.where(start >= 0, start, n + state)
    steps = length[start]
    begin = np.concatenate([[0], np.cumsum(steps)])
    owner = np.repeat(np.arange(len(start)), steps)
    place = np.arange(begin[-1]) - begin[owner]
    path = np.full(begin[-1], -1)
    path[begin[:-1][steps > 0]] = start[steps > 0]
    for k in range(len(pointers) - 1, -1, -1):
        jump = np.flatnonzero((place % (2 << k) == 0) & (place + (1 << k) < steps[owner]))
        path[jump + (1 << k)] = pointers[k][path[jump]]
    text = LABELS[label[path]].tobytes().decode() if len(path) else ""
    scripts: list[list[str | None]] = [[None] * 4 for _ in sizes]
    exits = np.full((len(sizes), 4), -1)
    exits[which, state] = pointers[-1][start] - n
    for i, (s, q) in enumerate(zip(which.tolist(), state.tolist())):
        scripts[s][q] = text[begin[i]:begin[i + 1]]
    costs = togo[borders[:-1] + np.arange(len(sizes))]
    return Paths(scripts, exits, costs)
