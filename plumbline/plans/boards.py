"""Boards of comparisons as lists of the pairs of models that met: which models are comparable, and their likeliest ratings.

Memory and work go by models and by pairs that met, never by all pairs of models. Models are numbers from 0.
"""

from __future__ import annotations

import numpy as np

#: Steps of the fit, of its inner solver, and where the score counts as zero.
STEPS, INNER, TOLERANCE = 100, 20_000, 1e-11


def parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By model, the least model that it leads to by pairs in either direction.

    Each round gives the labels at both ends of a pair the lesser of the two, then follows labels to their own; chains
    halve with each.
    """
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (further := new[new]) is not None and not np.array_equal(further, new):
            new = further
        if np.array_equal(new, label):
            return label
        label = new


def _lists(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each model's partners begin, and the partners b of a."""
    order = np.argsort(a, kind="stable")
    return np.concatenate(([0], np.cumsum(np.bincount(a, minlength=n)))), b[order]


def _reached(n: int, start: int, begins: np.ndarray, partners: np.ndarray) -> np.ndarray:
    seen = np.zeros(n, bool)
    seen[start] = True
    front = np.array([start])
    while len(front):
        sizes = begins[front + 1] - begins[front]
        at = np.repeat(begins[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        front = np.unique(partners[at])
        front = front[~seen[front]]
        seen[front] = True
    return seen


def one_strong_part(n: int, winner: np.ndarray, loser: np.ndarray) -> bool:
    """Whether every model leads to every other by wins."""
    return all(_reached(n, 0, *_lists(n, a, b)).all() for a, b in ((winner, loser), (loser, winner)))


def strong_parts(n: int, winner: np.ndarray, loser: np.ndarray) -> np.ndarray:
    """By model, the least model that it leads to by wins and that leads back.

    Models that nothing beats, or that beat nothing, stand alone and are trimmed first; what is left is walked in depth once.
    """
    out, left = np.arange(n), np.ones(n, bool)
    a, b = winner, loser
    while len(a):
        odd = left & ((np.bincount(a, minlength=n) == 0) | (np.bincount(b, minlength=n) == 0))
        keep = ~(odd[a] | odd[b])
        if not odd.any() or (keep.sum() > 0.99 * len(a)):  # a chain loses two models a round: the walk is faster
            break
        left &= ~odd
        a, b = a[keep], b[keep]
    begins, partners = (x.tolist() for x in _lists(n, a, b))
    number, low, stack, on, count = [-1] * n, [0] * n, [], [False] * n, 0
    for root in np.flatnonzero(left).tolist():
        if number[root] >= 0:
            continue
        walk = [(root, begins[root])]
        number[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while walk:
            v, at = walk[-1]
            if at < begins[v + 1]:
                walk[-1] = v, at + 1
                w = partners[at]
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    walk.append((w, begins[w]))
                elif on[w]:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    u = walk[-1][0]
                    low[u] = min(low[u], low[v])
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on[part[-1]] = False
                    least = min(part)
                    for w in part:
                        out[w] = least
    return out


def ends(n: int, winner: np.ndarray, loser: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the parts that lead to each other by wins: the first that lost to no other, and the first that beat no other.

    Models by number; both empty if there is one part only.
    """
    part = strong_parts(n, winner, loser)
    across = part[winner] != part[loser]
    if not across.any() and (part == part[0]).all():
        return np.zeros(0, int), np.zeros(0, int)
    out = []
    for side in (loser, winner):
        hit = np.zeros(n, bool)
        hit[part[side[across]]] = True
        free = np.flatnonzero(~hit & (part == np.arange(n)))
        out.append(np.flatnonzero(part == free[0]) if len(free) else np.zeros(0, int))
    return out[0], out[1]


def _solved(i: np.ndarray, j: np.ndarray, weight: np.ndarray, right: np.ndarray, close: float) -> np.ndarray:
    """x of mean zero with the sum of weight * (x_i - x_j) over each model's pairs equal to `right`, by conjugate gradients."""
    n = len(right)
    across = lambda v: np.bincount(i, u := weight * (v[i] - v[j]), n) - np.bincount(j, u, n)
    scale = np.maximum(np.bincount(i, weight, n) + np.bincount(j, weight, n), 1e-300)
    x, rest = np.zeros(n), right - right.mean()
    goal = close * np.abs(rest).max()
    z = rest / scale
    step, size = z.copy(), rest @ z
    for _ in range(INNER):
        if np.abs(rest).max() <= goal:
            break
        moved = across(step)
        rate = size / (step @ moved)
        x, rest = x + rate * step, rest - rate * moved
        z = rest / scale
        size, before = rest @ z, size
        step = z + size / before * step
    return x - x.mean()


def fitted(n: int, i: np.ndarray, j: np.ndarray, credit: np.ndarray) -> np.ndarray:
    """Most likely log odds, mean zero, of n models where i has so much credit over j; rows of one pair add up."""
    r = np.zeros(n)
    if n < 2:
        return r
    value = lambda r: -(credit * np.logaddexp(0, r[j] - r[i])).sum()
    enough = TOLERANCE * max(1.0, np.bincount(i, credit, n).max(), np.bincount(j, credit, n).max())
    now = value(r)
    for _ in range(STEPS):
        lost = (1 - np.tanh((r[i] - r[j]) / 2)) / 2
        pull = credit * lost
        score = np.bincount(i, pull, n) - np.bincount(j, pull, n)
        if np.abs(score).max() <= enough:
            break
        step = _solved(i, j, pull * (1 - lost), score, max(1e-13, min(0.01, np.abs(score).max())))
        rate = 1.0
        while (new := value(r + rate * step)) < now - 1e-12 * abs(now) and rate > 1e-6:
            rate /= 2
        r, now = r + rate * step, new
    return r - r.mean()
