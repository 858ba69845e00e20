"""Context-tree weighting: the numeric core, on arrays.

A byte is eight binary decisions; decision j (a prefix of the byte's bits, as a heap
number 1..255) has a context tree of its own, over the ``depth`` bytes before. A node
(context, j) holds how often the decision went either way after that context; its
Krichevsky-Trofimov estimate and what its children's weighted probabilities multiply
to are mixed with equal prior weight. Given all counts, the probability of a decision
is a mixture over the depths of the contexts' estimates.

Contexts are numbers with the most recent byte in the highest place, so that a
context's own context (one byte shorter) is a shift.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1 << 12
_HALF_LOG_PI = 0.5 * np.log(np.pi)
_harmonic = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])  # ln G(n + 1/2) / G(1/2)
_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])  # ln n!


def _rise(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """ln of shift * (shift + 1) * ... (n factors): by table, and by Stirling's series beyond."""
    out = table[np.minimum(n, _SMALL)]
    big = n > _SMALL
    if big.any():
        x = n[big] + shift
        base = _SMALL + shift
        series = lambda z: (z - 0.5) * np.log(z) - z + 1 / (12 * z) - 1 / (360 * z**3)
        out = out.copy()
        out[big] = table[_SMALL] + series(x) - series(base)
    return out


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in a row."""
    return _rise(n0, _harmonic, 0.5) + _rise(n1, _harmonic, 0.5) - _rise(n0 + n1, _factorial, 1.0)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def decisions(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From (context << 8 | byte) with counts to nodes (context << 8 | j), sorted, and
    their zeros and ones."""
    grams = grams.astype(np.uint64)
    context, byte = grams >> np.uint64(8) << np.uint64(8), grams & np.uint64(255)
    keys, zeros, ones = [], [], []
    for k in range(8):
        bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
        keys.append(context | np.uint64(1 << k) | byte >> np.uint64(8 - k))
        ones.append(np.where(bit == 1, counts, 0))
        zeros.append(np.where(bit == 1, 0, counts))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _groups(keys)
    total = lambda x: np.add.reduceat(np.concatenate(x)[order], at) if len(at) else np.zeros(0, np.int64)
    return keys[at], total(zeros), total(ones)


def up(keys: np.ndarray) -> np.ndarray:
    """The parents: the same decision after a context without its oldest byte."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)


def parents(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray):
    """One level up: (keys, n0, n1, what the children's weighted logs add up to, each
    child's parent's place)."""
    above = up(keys)
    order = np.argsort(above, kind="stable")
    at = _groups(above[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(np.bincount(at, minlength=len(keys))[: len(keys)]) - 1 if len(keys) else 0
    total = lambda x: np.add.reduceat(x[order], at) if len(at) else x[:0]
    return above[order][at], total(n0), total(n1), total(weighted), place


def mix(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the weighted probability, ln of how much likelier the children's is than
    the node's own estimate)."""
    own = kt_log(n0, n1)
    if below is None:
        return own, np.full(len(own), -np.inf)
    return np.logaddexp(own, below) - np.log(2), below - own


def climb(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray, steps: int):
    """The levels above some nodes: [keys, n0, n1, ratio, place] of each, deepest first, the
    given nodes' places, and the weighted logs of the shallowest."""
    levels, first = [], None
    for _ in range(steps):
        keys, n0, n1, below, place = parents(keys, n0, n1, weighted)
        if levels:
            levels[-1][4] = place
        else:
            first = place
        weighted, ratio = mix(n0, n1, below)
        levels.append([keys, n0, n1, ratio, None])
    return levels, first, weighted


class Tables:
    """A built tree: for each depth the sorted nodes and ln(p(one) / p(zero)) if that is
    the deepest node seen. Odds keep the rare side, however often the other was seen."""

    def __init__(self, keys: list[np.ndarray], odds: list[np.ndarray]):
        self.keys, self.odds = keys, odds

    @property
    def depth(self) -> int:
        return len(self.keys) - 1

    def log2(self, grams: np.ndarray) -> np.ndarray:
        """log2 of the probability of each gram's byte after its context; sorted grams
        are looked up fastest."""
        grams = grams.astype(np.uint64)
        context, byte = grams >> np.uint64(8), grams & np.uint64(255)
        out = np.zeros(len(grams))
        for k in range(8):
            j = np.uint64(1 << k) | byte >> np.uint64(8 - k)
            odds = np.zeros(len(grams))
            todo = np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                keys = self.keys[d]
                if not len(keys) or not len(todo):
                    continue
                want = context[todo] >> np.uint64(8 * (self.depth - d)) << np.uint64(8) | j[todo]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                odds[todo[hit]] = self.odds[d][at[hit]]
                todo = todo[~hit]
            bit = (byte >> np.uint64(7 - k)) & np.uint64(1)
            out -= np.logaddexp(0, np.where(bit == 1, -odds, odds))
        return out / np.log(2)


def leaves(grams: np.ndarray, counts: np.ndarray) -> tuple[list, np.ndarray]:
    """The deepest level, and its weighted logs."""
    keys, n0, n1 = decisions(grams, counts)
    weighted, ratio = mix(n0, n1, None)
    return [keys, n0, n1, ratio, None], weighted


#: What stands above the root: nothing decided for either side, the whole weight left.
ROOT = (0.0, 0.0, 1.0)


def build(grams: np.ndarray, counts: np.ndarray, depth: int) -> Tables:
    """The whole tree from all distinct (context << 8 | byte) and their counts."""
    low, weighted = leaves(grams, counts)
    levels, low[4], _ = climb(*low[:3], weighted, depth)
    levels = [low, *levels][::-1]
    return Tables([level[0] for level in levels], descend(levels, ROOT)[0])


def descend(levels: list, above: tuple) -> tuple[list[np.ndarray], tuple]:
    """From the shallowest level down: the log odds of each level's nodes, and what is
    decided for a one, for a zero, and left to deeper nodes after the last level. above:
    the same three before the first level, for each of its nodes or for all."""
    out = []
    with np.errstate(over="ignore"):
        for k, (_, n0, n1, ratio, place) in enumerate(levels):
            one, zero, left = (x[place] for x in above) if k else above
            own = left / (1 + np.exp(ratio)) / (n0 + n1 + 1.0)
            above = one, zero, left = one + own * (n1 + 0.5), zero + own * (n0 + 0.5), left / (1 + np.exp(-ratio))
            out.append(np.log((one + left / 2) / (zero + left / 2)))
    return out, above
