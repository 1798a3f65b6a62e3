"""A mergesort of suffixes that compares by prefix hashes."""

from __future__ import annotations

import numpy as np

from twinframe.llm.text import rolling

SEED = 11


def common_length(data, prefix, a, b, width):
    """Length of the common start of the suffixes at ``a`` and ``b``, at most ``width``: a binary search on hashes."""
    roll = rolling(SEED)
    length = np.full(len(a), width)
    pa, pb, scale_a, scale_b = prefix[a], prefix[b], roll.backs[a], roll.backs[b]
    open_ = np.flatnonzero((prefix[a + width] - pa) * scale_a != (prefix[b + width] - pb) * scale_b)
    a, b, pa, pb, scale_a, scale_b = (x[open_] for x in (a, b, pa, pb, scale_a, scale_b))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), width - 1)
    for _ in range((width - 1).bit_length()):
        middle = (low + high + 1) >> 1
        same = (prefix[a + middle] - pa) * scale_a == (prefix[b + middle] - pb) * scale_b
        low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
    length[open_] = low
    return length


def _before(data, prefix, a, b, width, or_equal):
    """Whether the suffix at ``a`` comes before that at ``b``, judged by the byte after their common start."""
    length = common_length(data, prefix, a, b, width)
    equal = length == width
    at = np.minimum(length, width - 1)
    return np.where(equal, or_equal, data[a + at] < data[b + at])


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, their first ``width`` bytes), and which equal the one before them.

    All groups are merged level by level: every suffix finds its place in the
    neighbouring run by binary search, so a suffix costs log(n) comparisons per
    level and a comparison log(width) hashes. Suffixes that come out equal are
    compared byte by byte, so a hash collision cannot make two strings one.
    Every start must have ``width`` bytes behind it.
    """
    roll = rolling(SEED)
    prefix = roll.of_bytes(data)
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order, np.zeros(0, bool)
    grouped = group[order]
    first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
    size = np.diff(np.concatenate([first, [len(order)]]))
    base, count = np.repeat(first, size), np.repeat(size, size)
    run = 1
    while run < size.max():
        at = np.flatnonzero(count > run)
        rank = at - base[at]
        mine = rank // run
        right = mine % 2 == 1
        low = base[at] + (mine + np.where(right, -1, 1)) * run
        high = np.minimum(low + run, base[at] + count[at])
        low = np.minimum(low, high)
        begin, item = low.copy(), starts[order[at]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            # how many of the other run come before: equal ones of a left run do, of a right run do not
            ahead = _before(data, prefix, starts[order[middle]], item[open_], width, right[open_])
            low[open_] = np.where(ahead, middle + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], middle)
        pair = base[at] + (mine - right) * run
        place = pair + rank % run + (low - begin)
        merged = order.copy()
        merged[place] = order[at]
        order = merged
        run *= 2
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(base[1:] == base[:-1]) + 1
    a, b = starts[order[near - 1]], starts[order[near]]
    equal = common_length(data, prefix, a, b, width) == width
    near, a, b = near[equal], a[equal], b[equal]
    for part in range(0, len(near), 1 << 14):
        piece = slice(part, part + (1 << 14))
        span = np.arange(width)
        same[near[piece]] = (data[a[piece, None] + span] == data[b[piece, None] + span]).all(axis=1)
    return order, same
