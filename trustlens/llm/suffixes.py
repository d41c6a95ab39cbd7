"""Multikey three-way quicksort of suffix pointers, in numpy.

A suffix is its first words' codes, one column for each place (code 0: the text ended). The quicksort takes a pivot
word for every range of pointers at once and parts the range into smaller, equal and larger; the equal part goes on
with the next place, up to the last one. The size of an equal part is the count of the words that it has in
common. A range too small to hold a frequent part is abandoned with all that is below it.
"""

from __future__ import annotations

import numpy as np


def equal_parts(columns: np.ndarray, weights: np.ndarray, lead: np.ndarray, least: int, seed: int = 11):
    """Yields (pointer, places, size) arrays of the equal parts: a suffix of the part, the places it has in common, the
    sum of its weights.

    columns: codes, a row for each place; weights: how often a suffix stands. ``lead``: a suffix's part of fewer than
    so many places may have members elsewhere; those are yielded whatever their size, the others from ``least`` on.
    """
    places, n = columns.shape
    flat, rng = np.ascontiguousarray(columns).ravel(), np.random.default_rng(seed)
    order, starts, depth = np.arange(n, dtype=np.int32), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while len(starts):
        lens = np.diff(starts, append=len(order))
        word = flat[np.repeat(depth * n, lens) + order]
        pivot = word[starts + (rng.random(len(starts)) * lens).astype(np.int64)]
        apart = word - np.repeat(pivot, lens)
        # each range's pointers in three runs: places before its own in the run, by running sums
        runs, base = [], starts
        to = np.empty(len(order), np.int32)
        for mine in (apart < 0, apart == 0, apart > 0):
            at = np.flatnonzero(mine)
            of = np.searchsorted(at, starts)
            held = np.diff(of, append=len(at))
            to[at] = np.arange(len(at)) + np.repeat(base - of, held)
            runs.append((base, held))
            base = base + held
        moved = np.empty_like(order)
        moved[to] = order
        order = moved

        new_starts = np.stack([r[0] for r in runs], 1).ravel()
        held = np.stack([r[1] for r in runs], 1).ravel()
        deeper = np.stack([depth, depth + 1, depth], 1).ravel()
        same = np.tile([False, True, False], len(starts))
        same_word = np.repeat(pivot, 3)
        keep = held > 0
        new_starts, held, deeper, same, same_word = (x[keep] for x in (new_starts, held, deeper, same, same_word))
        size = np.add.reduceat(weights[order], new_starts)
        partial = np.maximum.reduceat(lead[order], new_starts)

        found = same & (same_word > 0) & ((size >= least) | (partial > deeper))
        if found.any():
            yield order[new_starts[found]], deeper[found], size[found]
        go_on = np.where(same, found & (deeper < places), (size >= least) | (partial > deeper + 1))
        go_on &= same | (held > 0)
        order = order[np.repeat(go_on, held)]
        depth, lens = deeper[go_on], held[go_on]
        starts = np.cumsum(lens) - lens
