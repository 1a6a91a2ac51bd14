"""A double-array trie over sequences of small whole numbers, built and walked with numpy.

A number is a run of bytes, so no node has more than 256 children. `base` and `check` are the double array: the child of state s by byte b is
t = base[s] + b, if check[t] is s. Rows of many children get a block of their own; the others are thrown at random until they meet no
taken slot, all rows of a size at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ROW = 256


@dataclass
class Trie:
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # the number of the phrase that ends in a state, or -1
    digits: int  # bytes of a number

    def step(self, states: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more number each, and which of them there are."""
        there = np.arange(len(states))
        for d in reversed(range(self.digits)):
            t = self.base[states] + ((numbers[there] >> (8 * d)) & 255)
            ok = self.check[t] == states
            states, there = t[ok], there[ok]
        return states, there


def build(phrases: np.ndarray) -> Trie:
    """phrases: a row each, all of one length, whole numbers from 0 to 2**31 - 1, no two equal; accept gives the row's place."""
    m, k = phrases.shape
    digits = max(1, (int(phrases.max(initial=0)).bit_length() + 7) // 8)
    order = np.lexsort(phrases.T[::-1])
    bytes_ = np.ascontiguousarray(phrases[order].astype(">i4")).view(np.uint8).reshape(m, k, 4)[:, :, 4 - digits :].reshape(m, k * digits)
    parents, labels, above, nodes, new = [], [], np.zeros(m, np.int64), 1, np.zeros(m, bool)
    if m:
        new[0] = True
    for level in range(k * digits):
        new[1:] |= bytes_[1:, level] != bytes_[:-1, level]  # a row begins a node where it differs from the row before, up to this byte
        parents.append(above[new])
        labels.append(bytes_[new, level])
        above = nodes + np.cumsum(new) - 1
        nodes += int(new.sum())
    parent, label = np.concatenate(parents), np.concatenate(labels).astype(np.int64)  # of the nodes 1, 2, ...; parents never fall
    first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if m else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(parent)])
    wide = np.flatnonzero(sizes > 16)
    room = _ROW * (2 + len(wide)) + 4 * len(parent)
    taken, bases = np.zeros(room + _ROW, bool), np.zeros(len(first), np.int64)
    taken[:_ROW] = True  # the root is 0, and a leaf's base points here
    bases[wide] = _ROW * (1 + np.arange(len(wide)))
    taken[np.repeat(bases[wide], sizes[wide]) + label[_edges(first[wide], sizes[wide])]] = True
    random, owner = np.random.default_rng(11), np.full(room + _ROW, -1, np.int64)
    for low, high in ((9, 16), (5, 8), (2, 4), (1, 1)):
        left = np.flatnonzero((sizes >= low) & (sizes <= high))
        while len(left):
            at, starts = _edges(first[left], sizes[left]), np.r_[0, np.cumsum(sizes[left])[:-1]]
            tried = random.integers(_ROW, room, len(left))
            slots, who = np.repeat(tried, sizes[left]) + label[at], np.repeat(left, sizes[left])
            free = np.logical_and.reduceat(~taken[slots], starts)
            mine = np.repeat(free, sizes[left])
            owner[slots[mine]] = who[mine]
            won = free & np.logical_and.reduceat(owner[slots] == who, starts)
            bases[left[won]] = tried[won]
            taken[slots[np.repeat(won, sizes[left])]] = True
            left = left[~won]
    slot = np.zeros(nodes, np.int64)
    slot[1:] = np.repeat(bases, sizes) + label
    base, check, accept = np.zeros(room + _ROW, np.int32), np.full(room + _ROW, -1, np.int32), np.full(room + _ROW, -1, np.int32)
    base[slot[parent[first]]] = bases
    check[slot[1:]] = slot[parent]
    accept[slot[above]] = order
    return Trie(base, check, accept, digits)


def _edges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., for as many as sizes[0]; then those of the next row."""
    return np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(first) else np.zeros(0, np.int64)


def match(trie: Trie, numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, phrases): where a phrase of `length` numbers begins. All positions advance together; negative numbers match nothing."""
    at = np.flatnonzero(numbers[: len(numbers) - length + 1] >= 0) if len(numbers) >= length else np.zeros(0, np.int64)
    states = np.zeros(len(at), np.int64)
    for j in range(length):
        c = numbers[at + j]
        real = (c >= 0) & (c < 1 << (8 * trie.digits))
        states, there = trie.step(states[real], c[real])
        at = at[real][there]
    return at, trie.accept[states]
