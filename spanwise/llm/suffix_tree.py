"""Suffix trees by Ukkonen's construction, with lowest common ancestors in constant time."""

from __future__ import annotations

from array import array

import numpy as np

#: Entries of the Euler tour in a block; queries within one block look at its entries.
_BLOCK = 32


class RangeMinimum:
    """Minima of ranges of an array in constant time and linear memory: a sparse table over blocks, scans within."""

    def __init__(self, values: np.ndarray) -> None:
        pad = -len(values) % _BLOCK
        top = np.iinfo(values.dtype).max
        self.blocks = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, _BLOCK)
        self.from_left = np.minimum.accumulate(self.blocks, 1).ravel()
        self.from_right = np.minimum.accumulate(self.blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.values = self.blocks.ravel()
        level = self.from_right[::_BLOCK]
        self.table = [level]
        width = 1
        while 2 * width <= len(level):
            self.table.append(np.minimum(self.table[-1][:-width], self.table[-1][width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Smallest value from a to b, both included, for arrays of bounds."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        left, right = low // _BLOCK, high // _BLOCK
        found = np.minimum(self.from_right[low], self.from_left[high])
        between = right - left - 1
        for k in np.unique(np.frexp(between[between > 0])[1]) - 1:
            at = np.flatnonzero((between > 0) & (np.frexp(between)[1] - 1 == k))
            level = self.table[k]
            found[at] = np.minimum(found[at], np.minimum(level[left[at] + 1], level[right[at] - (1 << k)]))
        same = np.flatnonzero(left == right)
        found[same] = self.values[low[same]]
        for step in range(1, _BLOCK):
            same = same[low[same] + step <= high[same]]
            if not len(same):
                break
            found[same] = np.minimum(found[same], self.values[low[same] + step])
        return found


class SuffixTree:
    """Tree of all suffixes of a sequence of numbers whose last number occurs nowhere else.

    `rank[i]` is the place of the suffix from i among all suffixes in order;
    `common(i, j)` the length of the longest common prefix of the suffixes from i
    and j, which is the depth of the lowest common ancestor of their leaves.
    """

    def __init__(self, text: np.ndarray) -> None:
        first, last, child, letters = _ukkonen(text.tolist())
        tour, place, self.rank = _euler_tour(len(text), first, last, child, letters)
        self.place = place
        self.minimum = RangeMinimum(tour)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.minimum(self.place[i], self.place[j])


def _ukkonen(text: list[int]) -> tuple[array, array, dict[int, int], int]:
    """Nodes with the part of the text on the edge above them, and children by (node, first letter) as one number.

    Letters are read one by one. The active point (`node`, and `length` letters from
    `edge` on below it) is where the longest suffix that is not yet a leaf ends.
    """
    n, letters = len(text), max(text) + 1
    first, last, link = array("q", [0]), array("q", [0]), array("q", [0])
    child: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, letter in enumerate(text):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            key = node * letters + text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                start = first[below]
                size = last[below] - start
                if length >= size:
                    node, edge, length = below, edge + size, length - size
                    continue
                if text[start + length] == letter:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(first)
                first.extend((start, i))
                last.extend((start + length, n))
                link.extend((0, 0))
                first[below] = start + length
                child[key] = middle
                child[middle * letters + text[start + length]] = below
                child[middle * letters + letter] = middle + 1
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return first, last, child, letters


def _euler_tour(
    n: int, first: array, last: array, child: dict[int, int], letters: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths (in letters) along the Euler tour, the place of each suffix's leaf on it, and the order of suffixes."""
    keys = np.fromiter(child.keys(), np.int64, len(child))
    order = np.argsort(keys)
    below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
    child.clear()
    nodes = len(first)
    bounds = np.searchsorted(keys[order] // letters, np.arange(nodes + 1)).tolist()
    size = (np.array(last) - np.array(first)).tolist()
    depth = [0] * nodes
    upcoming = bounds[:-1]
    tour, place, rank = array("i"), [0] * n, [0] * n
    path, leaves = [0], 0
    while path:
        node = path[-1]
        tour.append(depth[node])
        at = upcoming[node]
        if at < bounds[node + 1]:
            upcoming[node] = at + 1
            lower = below[at]
            depth[lower] = depth[node] + size[lower]
            path.append(lower)
            continue
        if node and bounds[node] == bounds[node + 1]:
            suffix = n - depth[node]
            place[suffix], rank[suffix] = len(tour) - 1, leaves
            leaves += 1
        path.pop()
    return np.array(tour), np.array(place), np.array(rank)
