"""Topic shares of documents under word weights, many documents at a time."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17  # fixed value: word weights worked on at a time, what a core's cache holds
NEAR = 1e-3  # fixed value of Spark ML: mean step at which a document's parameters are settled


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: eight steps up, then the series for large ones."""
    pair = x * (x + 7)  # 1/x + 1/(x + 7) = (2x + 7) / pair, and so on inwards
    steps = (2 * x + 7) * (1 / pair + 1 / (pair + 6) + 1 / (pair + 10) + 1 / (pair + 12))
    up = 1 / (x + 8)
    s = up * up
    series = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return -np.log(up) - 0.5 * up - series - steps


def expectation(x: np.ndarray) -> np.ndarray:
    """Mean logarithm of the shares of Dirichlet distributions, one per row."""
    both = digamma(np.concatenate([x, x.sum(axis=-1, keepdims=True)], axis=-1))
    return both[..., :-1] - both[..., -1:]


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma``."""
    up = 1 / (x + 8)
    s = up * up
    series = up * s * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66))))
    return up + s / 2 + series + (1 / (x[..., None] + np.arange(8)) ** 2).sum(axis=-1)


def mean_shares(x: np.ndarray) -> np.ndarray:
    """``exp(expectation(x))`` in fewer calls: eight steps up, then the series of exp(digamma)."""
    both = np.empty((len(x), x.shape[1] + 1))
    both[:, :-1] = x
    x.sum(axis=1, out=both[:, -1])
    pair = both + 7
    pair *= both
    steps = 1 / pair
    for add in (6, 4, 2):  # pair + 6, pair + 10, pair + 12
        pair += add
        steps += 1 / pair
    both += 3.5
    steps *= both
    steps *= -2
    np.exp(steps, out=steps)
    both += 4
    up = 1 / both
    s = up * up
    series = s * (5509121 / 1393459200)
    for c in (10313 / 2903040, 37 / 5760, 1 / 24):
        np.subtract(c, series, out=series)
        series *= s if c < 1 / 24 else up
    both += series
    both *= steps
    return both[:, :-1] / both[:, -1:]


def infer(starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray,
          weights: np.ndarray, alpha: np.ndarray,
          first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variational parameters per document and, per word of each, its count over its norm.

    Document i has the ``sizes[i]`` words of ``ids`` from ``starts[i]``, at least one; ``weights``
    has a row per topic. Every document begins at ``first`` and steps until a step moves its parameters by at
    most ``NEAR`` on average, as in Spark ML. A step is a few calls for a block of documents of
    like length; as documents settle, others take their place.
    """
    k = len(alpha)
    gammas, ratios = np.empty((len(sizes), k)), np.zeros(len(ids))
    order, taken = np.argsort(-sizes, kind="stable"), 0
    first_share = mean_shares(first[None])[0]
    width = int(sizes.max(initial=0))
    # two tables of weights in turn: fresh memory would be mapped anew for every block
    spare = [np.empty(max(BLOCK, k * width)) for _ in range(2)]
    docs, table, going = np.empty(0, int), np.empty((0, k, width)), np.empty(0, bool)
    gamma, share = np.empty((0, k)), np.empty((0, k))
    cell, ratio = np.empty((0, width)), np.empty((0, width))
    while going.any() or taken < len(order):
        docs = docs[going]
        width = int(max(sizes[docs].max(initial=0), sizes[order[taken:taken + 1]].max(initial=0)))
        new = order[taken:taken + max(BLOCK // (width * k) - len(docs), 0 if len(docs) else 1)]
        taken += len(new)
        place = starts[new, None] + np.arange(width)
        inside = np.arange(width) < sizes[new, None]
        place[~inside] = 0
        old, total = len(docs), len(docs) + len(new)
        held = spare[0][:total * k * width].reshape(total, k, width)
        spare.reverse()
        for i, j in enumerate(np.flatnonzero(going)):
            held[i] = table[j, :, :width]
        words = ids[place]
        for i in range(k):
            held[old:, i] = weights[i][words]
        table = held
        fresh = np.where(inside, counts[place], 0.0)
        cell = np.concatenate([cell[going, :width], fresh])
        ratio = np.concatenate([ratio[going, :width], fresh / (
            np.matmul(first_share, table[old:]) + 1e-100)])
        gamma = np.concatenate([gamma[going], np.tile(first, (len(new), 1))])
        share = np.concatenate([share[going], np.tile(first_share, (len(new), 1))])
        docs = np.concatenate([docs, new])
        going = np.ones(len(docs), bool)
        while 4 * np.count_nonzero(going) > 3 * len(going):
            last = gamma
            gamma = share * np.matmul(table, ratio[:, :, None])[:, :, 0] + alpha
            share = mean_shares(gamma)
            norm = np.matmul(share[:, None], table)[:, 0]
            norm += 1e-100
            ratio = np.divide(cell, norm, out=norm)
            settled = going & (np.abs(gamma - last).sum(axis=1) <= NEAR * k)
            if settled.any():
                for i in np.flatnonzero(settled):
                    at, size = starts[docs[i]], sizes[docs[i]]
                    gammas[docs[i]], ratios[at:at + size] = gamma[i], ratio[i, :size]
                going &= ~settled
    return gammas, ratios
