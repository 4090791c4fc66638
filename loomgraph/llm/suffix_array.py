"""Two-stage suffix sorting in numpy.

A suffix is *rising* if it is smaller than its successor. Only rising suffixes
are sorted directly; all others are induced by one scan over the buckets of
first bytes: the suffix before a sorted one, if not rising, is next in its
bucket. The scan goes a whole bucket at a time. Order is by the first ``depth``
symbols at least, which is all that matching strings of that length needs.
"""

from __future__ import annotations

import numpy as np


def rising(text: np.ndarray) -> np.ndarray:
    """Per position: the suffix is smaller than the next one; the last is not. Equal neighbours are as the next unequal pair."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    up, differ = text[:-1] < text[1:], text[:-1] != text[1:]
    at = np.where(differ, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    out[:-1] = np.append(up, False)[following]
    return out


#: Symbols that are packed into one number, and bits of a symbol.
PACKED, BITS = 7, 9


def packed(text: np.ndarray) -> np.ndarray:
    """From each position, ``PACKED`` symbols as one number that sorts like them; beyond the end are zeros."""
    padded = np.concatenate([text, np.zeros(PACKED, text.dtype)]).astype(np.uint64)
    out = padded[: len(text)].copy()
    for k in range(1, PACKED):
        out <<= np.uint64(BITS)
        out |= padded[k : len(text) + k]
    return np.concatenate([out, np.zeros(1, np.uint64)])


def _at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(words, at, mode="clip")  # beyond the end is the last one, which is 0


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes' first ``depth`` symbols; ties keep their order."""
    word = _at(words, at)
    by = np.argsort(word, kind="stable")
    order, word = at[by], word[by]
    group = np.zeros(len(at), np.int64)
    group[1:] = np.cumsum(word[1:] != word[:-1])
    # only positions that are tied go on; their places among all stay
    place = np.arange(len(at))
    for k in range(PACKED, depth, PACKED):
        tied = np.zeros(len(place), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        place, group = place[tied], group[tied]
        if not len(place):
            break
        now = order[place]
        word = _at(words, now + k)
        by = np.lexsort((word, group))
        order[place], word = now[by], word[by]
        new = np.ones(len(place), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """All positions of ``text`` (symbols below 2**BITS) in suffix order, by ``depth`` symbols at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    is_rising = rising(text)
    direct = sort_directly(packed(text) if words is None else words, np.flatnonzero(is_rising), depth)
    first = text[direct]
    symbols = np.unique(text)
    falling: dict[int, list[np.ndarray]] = {int(c): [] for c in symbols}
    falling[int(text[-1])].append(np.array([n - 1]))  # the end comes before everything
    out = []
    for c in symbols.tolist():
        sorted_here = []
        now = np.concatenate(falling.pop(c)) if falling[c] else np.zeros(0, np.int64)
        while len(now):  # runs of one symbol induce within their own bucket
            sorted_here.append(now)
            before = now[now > 0] - 1
            now = before[(text[before] == c) & ~is_rising[before]]
        sorted_here.append(direct[np.searchsorted(first, c, "left") : np.searchsorted(first, c, "right")])
        bucket = np.concatenate(sorted_here)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~is_rising[before]]
        if len(before):
            by = np.argsort(text[before], kind="stable")
            before = before[by]
            cuts = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cuts):
                falling[int(text[part[0]])].append(part)
    return np.concatenate(out)


def common_at_least(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` share a prefix of ``length`` symbols, ``PACKED`` or more; ``words`` are the packed text."""
    left = np.arange(len(a))
    for k in range(0, length, PACKED):
        k = min(k, length - PACKED)
        left = left[_at(words, a[left] + k) == _at(words, b[left] + k)]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out
