"""Deep-shallow sorting of suffixes, on numpy arrays; all groups take a step at once.

Shallow: a multikey quicksort whose symbols are eight bytes wide parts each group of suffixes by the next symbol, down
to ``SHALLOW`` bytes. Deep: what then still shares a prefix goes into blind tries. A trie keeps, for the path to
one leaf, only how far down each branch leaves it and by which byte, so placing a suffix takes one comparison
with the leaf; suffixes that leave at one place by one byte are a group of their own, with its own trie.
"""

from __future__ import annotations

import numpy as np

WIDE = 8
SHALLOW = 16
ROWS = 100_000


def _wide(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, WIDE)[at].view(">u8").reshape(-1).astype(np.uint64)


def _leave(text: np.ndarray, at: np.ndarray, leaf: np.ndarray, low: int, depth: int) -> np.ndarray:
    """First place, from ``low``, where suffixes differ from their leaf; ``depth`` if none."""
    view, out = np.lib.stride_tricks.sliding_window_view(text, depth - low), np.empty(len(at), np.int64)
    for i in range(0, len(at), ROWS):
        differ = view[at[i : i + ROWS] + low] != view[leaf[i : i + ROWS] + low]
        first = differ.argmax(axis=1)
        out[i : i + ROWS] = np.where(differ[np.arange(len(first)), first], low + first, depth)
    return out


def deep_shallow(text: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by group, then by their first ``depth`` bytes, and for each place of it whether
    the suffix equals the one before. Every suffix must have ``depth`` bytes in ``text``.
    """
    n = len(starts)
    order = np.argsort(group, kind="stable")
    head = np.append(True, group[order][1:] != group[order][:-1]) if n else np.empty(0, bool)

    def groups() -> tuple[np.ndarray, np.ndarray]:
        """Places in groups of two and more, and the number of the group of each."""
        number = np.cumsum(head) - 1
        many = np.bincount(number)[number] > 1
        return np.flatnonzero(many), number[many]

    for low in range(0, SHALLOW, WIDE):
        places, number = groups()
        if not len(places):
            break
        key = _wide(text, starts[order[places]] + low)
        by = np.lexsort((key, number))
        order[places], key = order[places][by], key[by]
        head[places[1:]] |= key[1:] != key[:-1]

    places, number = groups()
    equal = np.zeros(n, bool)
    while len(places):
        first = np.append(True, number[1:] != number[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        at = starts[order[places]]
        leaf = np.repeat(at[first], size)
        leave = _leave(text, at, leaf, SHALLOW, depth)
        same = leave == depth
        mine, leafs = (np.where(same, 0, text[x + np.minimum(leave, depth - 1)].astype(np.int64)) for x in (at, leaf))
        # Before the leaf those with a smaller byte, the earlier they leave the sooner; behind it the other way round.
        side = np.where(mine < leafs, leave, 2 * depth - leave)
        by = np.lexsort((mine, side, number))
        order[places] = order[places][by]
        side, mine, same = side[by], mine[by], same[by]
        differs = np.append(True, (number[1:] != number[:-1]) | (side[1:] != side[:-1]) | (mine[1:] != mine[:-1]))
        head[places] |= differs
        equal[places] = same & ~differs
        # Leaves are done; the groups that hang at the branches go on.
        rest = ~same
        number = np.cumsum(differs)[rest]
        places = places[rest]
        if len(places):
            many = np.bincount(number)[number] > 1
            places, number = places[many], number[many]
    return order, equal
