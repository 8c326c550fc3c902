"""Many smooth functions minimised side by side, so that one pass over a table serves all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_KEPT = 10         # steps from which a direction is made
_FALL = 1e-4       # share of the promised fall a step must bring
_SHORTEST = 1e-6   # steps are not halved below this


def minimise(
    evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, steps: int,
    flat: float = 1e-4, still: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """(points, whether each has settled) of limited-memory BFGS with halved steps (Nocedal and Wright 2006).

    `evaluate` gets the points of some functions, one per row, and which ones
    these are, and returns their values and gradients. A function has settled
    once its gradient is below `flat` or a step lowers it by less than `still`
    of its value.
    """
    point, many = start.copy(), len(start)
    value, slope = evaluate(point, np.arange(many))
    moves, turns = np.zeros((2, _KEPT, *point.shape))
    inverse = np.zeros((_KEPT, many))  # 0 where no step is kept
    settled = np.abs(slope).max(axis=1) <= flat
    taken, length = np.zeros(many, int), np.ones(many)
    way = -slope / np.maximum(1.0, np.linalg.norm(slope, axis=1))[:, None]
    live = np.flatnonzero(~settled)
    while len(live):
        tried = point[live] + length[live, None] * way[live]
        new, new_slope = evaluate(tried, live)
        promised = length[live] * (slope[live] * way[live]).sum(axis=1)
        fell = new <= value[live] + _FALL * promised
        length[live[~fell]] *= 0.5
        on, tried, new, new_slope = live[fell], tried[fell], new[fell], new_slope[fell]
        move, turn = tried - point[on], new_slope - slope[on]
        bend = (move * turn).sum(axis=1)
        settled[on] = (np.abs(new_slope).max(axis=1) <= flat) | (value[on] - new <= still * np.abs(value[on]))
        point[on], value[on], slope[on] = tried, new, new_slope
        taken[on] += 1
        length[on] = 1.0
        bent = bend > 1e-12
        for kept, own in ((moves, move), (turns, turn), (inverse, 1.0 / np.where(bent, bend, 1.0))):
            kept[:-1, on[bent]] = kept[1:, on[bent]]
            kept[-1, on[bent]] = own[bent]
        way[on] = _direction(slope[on], moves[:, on], turns[:, on], inverse[:, on])
        live = live[~settled[live] & (taken[live] < steps) & (length[live] > _SHORTEST)]
    return point, settled


def _direction(slope: np.ndarray, moves: np.ndarray, turns: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    way, shares = -slope, np.zeros(inverse.shape)
    for i in reversed(range(len(moves))):
        shares[i] = inverse[i] * (moves[i] * way).sum(axis=1)
        way = way - shares[i][:, None] * turns[i]
    bend = inverse[-1] * (turns[-1] ** 2).sum(axis=1)
    way = way / np.where(bend > 0, bend, np.maximum(1.0, np.linalg.norm(slope, axis=1)))[:, None]
    for i in range(len(moves)):
        way = way + (shares[i] - inverse[i] * (turns[i] * way).sum(axis=1))[:, None] * moves[i]
    return way
