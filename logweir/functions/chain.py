"""Greedy spacing of sorted times: the one computation that needs Python.

Kept free of other imports of the package, so that workers need not have it
installed (see `pickle_by_value` below).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle


def spaced_positions(times: np.ndarray, gap: int, strict: bool, last: int | None) -> list[int]:
    """Positions kept when each must lie at least `gap` after the one before.

    `times` is sorted. With `strict` the distance must exceed the gap. `last` is
    the time kept before this stretch. One binary search per kept position.
    """
    side = "right" if strict else "left"
    position = 0 if last is None else int(np.searchsorted(times, last + gap, side))
    kept = []
    while position < len(times):
        kept.append(position)
        position = int(np.searchsorted(times, times[position] + gap, side))
    return kept


def block_steps(times: np.ndarray, begin: int, gap: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a block of sorted times makes of the time kept before it, as a step function.

    Chains never overtake one another and soon run together, so neighbouring first times
    end alike. Returned are (starts, lasts): of each run of first times that end alike, the
    latest, and the time they end with. All kept times before the block lie before `begin`.
    """
    side = "right" if strict else "left"
    after = np.searchsorted(times, times + gap, side)
    own = np.arange(len(times))
    end = np.where(after < len(times), after, own)
    while True:  # each round doubles the steps taken
        further = end[end]
        if (further == end).all():
            break
        end = further
    # No kept time before the block can lead beyond the first time this late.
    reach = int(np.searchsorted(times, begin - 1 + gap, side)) + 1
    lasts = times[end[:reach]]
    run_ends = np.flatnonzero(np.append(lasts[1:] != lasts[:-1], True))
    return times[:reach][run_ends], lasts[run_ends]


def step(starts: np.ndarray, lasts: np.ndarray, gap: int, strict: bool, last: int | None) -> int:
    """The last kept time after a block, from that before it."""
    if last is None:
        return int(lasts[0])
    run = int(np.searchsorted(starts, last + gap, "right" if strict else "left"))
    return int(lasts[run]) if run < len(starts) else last


cloudpickle.register_pickle_by_value(sys.modules[__name__])
