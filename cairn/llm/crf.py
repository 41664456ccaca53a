"""Linear-chain conditional random field over integer features (numpy).

A position has ``F`` feature ids; its score for state ``y`` is the sum of
``w[id, y]``; ``a[x, y]`` scores a step from state ``x`` to ``y``. ``fit``
maximises the regularised likelihood by forward-backward and Adam on padded
sequences; ``viterbi`` decodes many sequences side by side.
"""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def posteriors(e: np.ndarray, a: np.ndarray, n: np.ndarray):
    """(log likelihood of all paths, state and step marginals) of padded scores ``e`` [b, t, k]."""
    b, t, k = e.shape
    f, r = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for i in range(1, t):
        f[:, i] = np.where((i < n)[:, None], _lse(f[:, i - 1, :, None] + a, 1) + e[:, i], f[:, i - 1])
    for i in range(t - 2, -1, -1):
        r[:, i] = np.where((i + 1 < n)[:, None], _lse(a + (e[:, i + 1] + r[:, i + 1])[:, None, :], 2), 0.0)
    z = _lse(f[:, -1], 1)
    on = (np.arange(t) < n[:, None])[..., None]
    states = np.exp(f + r - z[:, None, None]) * on
    step = np.exp(f[:, :-1, :, None] + a + (e[:, 1:] + r[:, 1:])[:, :, None, :] - z[:, None, None, None])
    step *= (np.arange(1, t) < n[:, None])[..., None, None]
    return z, states, step


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, n_ids: int, k: int, steps: int = 60, rate: float = 0.15, l2: float = 1e-3):
    """Weights (w, a) from ids ``x`` [b, t, f] (``n_ids`` stands for none),
    states ``y`` [b, t] and lengths ``n``."""
    b, t, f = x.shape
    w, a = np.zeros((n_ids + 1, k)), np.zeros((k, k))
    if not b:
        return w, a
    on = np.arange(t) < n[:, None]
    total = max(1, int(on.sum()))
    flat = x[on]
    gold = np.zeros((b, t, k))
    np.put_along_axis(gold, y[..., None], 1.0, axis=2)
    gold *= on[..., None]
    pairs = np.zeros((k, k))
    both = on[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    m = [np.zeros_like(w), np.zeros_like(a)]
    v = [np.zeros_like(w), np.zeros_like(a)]
    for s in range(1, steps + 1):
        e = w[x].sum(axis=2)
        _, states, step = posteriors(e, a, n)
        diff = (states - gold)[on]
        gw = np.column_stack([np.bincount(flat.ravel(), weights=np.repeat(diff[:, j], f), minlength=n_ids + 1) for j in range(k)]) / total + l2 * w / 10
        ga = (step.sum(axis=(0, 1)) - pairs) / total + l2 * a
        gw[n_ids] = 0
        for j, (p, g) in enumerate(((w, gw), (a, ga))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            p -= rate * (m[j] / (1 - 0.9**s)) / (np.sqrt(v[j] / (1 - 0.99**s)) + 1e-8)
    return w, a


def viterbi(e: np.ndarray, first: np.ndarray, a: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Best states of sequences that stand one after another in ``e`` [n, k];
    sequence i is e[first[i]: first[i + 1]]. ``begin`` and ``end`` are added to
    the scores of each sequence's first and last position ([sequences, k]).
    Ties go to the lower state."""
    n, k = e.shape
    out = np.zeros(n, dtype=np.int8)
    ln = np.diff(first)
    order = np.argsort(-ln, kind="stable")
    order = order[ln[order] > 0]
    if not len(order):
        return out
    at, ln = first[:-1][order], ln[order]
    back = np.zeros((n, k), dtype=np.int8)
    v = e[at] + (begin[order] if begin is not None else 0)
    last = np.zeros_like(v)
    alive = len(order)
    for t in range(int(ln[0])):
        if t:
            s = v[:alive, :, None] + a
            p = at[:alive] + t
            best = s.argmax(axis=1)
            back[p] = best
            v[:alive] = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + e[p]
        stay = int(np.searchsorted(-ln, -(t + 1), side="left"))  # sequences longer than t + 1 positions
        last[stay:alive] = v[stay:alive]
        alive = stay
    y = (last + (end[order] if end is not None else 0)).argmax(axis=1).astype(np.int8)
    alive = 0
    for t in range(int(ln[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-ln, -t, side="left"))  # those longer than t
        p = at[:alive] + t
        out[p] = y[:alive]
        y[:alive] = back[p, y[:alive]]
    return out


def pad(seqs: list[tuple[np.ndarray, np.ndarray]], none: int):
    """Padded (x, y, n) of (ids [t, f], states [t]) sequences."""
    t = max((len(y) for _, y in seqs), default=1)
    f = seqs[0][0].shape[1] if seqs else 1
    x = np.full((len(seqs), t, f), none, dtype=np.int64)
    y = np.zeros((len(seqs), t), dtype=np.int64)
    n = np.zeros(len(seqs), dtype=np.int64)
    for i, (a, b) in enumerate(seqs):
        x[i, : len(b)], y[i, : len(b)], n[i] = a, b, len(b)
    return x, y, n
