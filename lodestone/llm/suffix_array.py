"""Suffix arrays by induced sorting, a bucket at a time in numpy."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes, those smaller than the next; the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next change decides a run of equal symbols
    s = np.ones(n, dtype=bool)
    s[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return s


def _deal(sa: np.ndarray, place: np.ndarray, pred: np.ndarray, sym: np.ndarray, forward: bool) -> None:
    """Puts suffixes in order at the heads (or, from the right, the tails) of their buckets."""
    order = np.argsort(sym, kind="stable")
    pred, sym = pred[order], sym[order]
    first = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    size = np.diff(np.append(first, len(sym)))
    rank = np.arange(len(sym)) - np.repeat(first, size)
    if forward:
        sa[place[sym] + rank] = pred
        place[sym[first]] += size
    else:
        sa[place[sym] - rank] = pred
        place[sym[first]] -= size


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes in the order that the given order of the leftmost S-type ones induces."""
    n = len(t)
    sa = np.empty(n, dtype=np.int32)
    total = np.bincount(t, minlength=sigma)
    end = np.cumsum(total)
    low = np.bincount(t[~s], minlength=sigma)
    start = end - total
    head, by = start.copy(), t[lms]
    order = np.argsort(by, kind="stable")
    own, bounds = lms[order], np.searchsorted(by[order], np.arange(sigma + 1))
    for c in np.flatnonzero(total):
        done = start[c]
        while done < head[c]:  # entries that this bucket gives itself come in further rounds
            batch, done = sa[done : head[c]], head[c]
            pred = batch[batch > 0] - 1
            pred = pred[~s[pred]]
            if len(pred):
                _deal(sa, head, pred, t[pred], True)
        pred = own[bounds[c] : bounds[c + 1]]
        pred = pred[pred > 0] - 1
        if len(pred):
            _deal(sa, head, pred, t[pred], True)
    tail = end - 1
    for c in np.flatnonzero(total)[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            batch, done = sa[tail[c] + 1 : done + 1][::-1], tail[c]
            pred = batch[batch > 0] - 1
            pred = pred[s[pred]]
            if len(pred):
                _deal(sa, tail, pred, t[pred], False)
        if low[c]:
            batch = sa[start[c] : start[c] + low[c]][::-1]
            pred = batch[batch > 0] - 1
            pred = pred[s[pred]]
            if len(pred):
                _deal(sa, tail, pred, t[pred], False)
        if c == t[-1]:
            sa[end[c] - 1] = n - 1
    return sa


def suffix_array(symbols: np.ndarray, sigma: int, depth: int) -> np.ndarray:
    """Start positions of all suffixes of `symbols` (numbers from 1 to sigma - 1) in order of their first `depth` symbols at least.

    Classifies suffixes, sorts the substrings between leftmost S-type positions by inducing, names them, sorts the
    names' sequence by doubling (to the depth asked for, at least two symbols a name) and induces the whole order.
    """
    t = np.append(symbols, 0).astype(np.int16 if sigma < 2**15 else np.int32)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        is_lms = np.zeros(len(t), dtype=bool)
        is_lms[lms] = True
        sa = _induce(t, s, lms, sigma)
        by = sa[is_lms[sa]]
        # equal neighbours get one name: compare the substrings symbol by symbol, those that differ drop out
        nth = np.empty(len(t), dtype=np.int32)
        nth[lms] = np.arange(len(lms), dtype=np.int32)
        length = np.append(np.diff(lms), 0)[nth[by]]
        same = np.zeros(len(by), dtype=bool)
        left = np.flatnonzero(length[1:] == length[:-1]) + 1
        k = 0
        while len(left):
            left = left[t[by[left] + k] == t[by[left - 1] + k]]
            over = length[left] == k
            same[left[over]] = True
            left, k = left[~over], k + 1
        rank = np.empty(len(by), dtype=np.int64)
        rank[nth[by]] = np.cumsum(~same)
        width = 1
        while width * 2 < depth + 2 and rank.max() < len(rank):
            pair = rank << 32
            pair[:-width] |= rank[width:]
            order = np.argsort(pair, kind="stable")
            new = np.ones(len(order), dtype=np.int64)
            new[1:] = pair[order[1:]] != pair[order[:-1]]
            rank[order] = np.cumsum(new)
            width *= 2
        lms = lms[np.argsort(rank, kind="stable")]
    sa = _induce(t, s, lms, sigma)
    return sa[1:]


def words(a: np.ndarray, width: int = 8) -> np.ndarray:
    """The `width` (a power of two up to 8) bytes from each position on as one number."""
    u, s = a.astype(np.uint64), 1
    while s < width:
        u = u[:-s] | (u[s:] << np.uint64(8 * s))
        s *= 2
    return u


def repeat_groups(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, whether each shares its first `length` (8 or more) bytes with the one before: the common
    prefix of a position and its forerunner, read no farther than `length`."""
    u = words(text)
    same = np.zeros(len(sa), dtype=bool)
    left = np.arange(1, len(sa))
    for o in [*range(0, length - 8, 8), length - 8]:
        left = left[u[sa[left] + o] == u[sa[left - 1] + o]]
    same[left] = True
    return same
