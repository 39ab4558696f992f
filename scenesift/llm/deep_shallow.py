"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries for what is still equal there."""

from __future__ import annotations

import numpy as np

#: Symbols of eight bytes that the quicksort compares before a group goes to a blind trie.
SHALLOW = 2


def multikey_quicksort(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Groups of rows in sorted order; rows of one group are equal in their first ``depth`` symbols."""
    groups: list[np.ndarray] = []
    stack = [(np.arange(len(symbols)), 0)]
    while stack:
        rows, at = stack.pop()
        if len(rows) <= 1 or at == depth:
            if len(rows):
                groups.append(rows)
            continue
        value = symbols[rows, at]
        pivot = np.partition(value, len(value) // 2)[len(value) // 2]
        less, more = value < pivot, value > pivot
        # Last pushed is sorted next: smaller ones, then equal ones by their next symbol, then larger ones.
        stack.append((rows[more], at))
        stack.append((rows[~less & ~more], at + 1))
        stack.append((rows[less], at))
    return groups


class BlindTrie:
    """Patricia trie that compares only the bytes at which it branches, and one whole leaf for each string."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.size = strings, len(strings[0])
        self.values = [int.from_bytes(s, "big") for s in strings]
        self.equal: dict[int, list[int]] = {0: [0]}
        self.root: list | int = 0
        for n in range(1, len(strings)):
            self._insert(n)

    def _insert(self, n: int) -> None:
        new, path, node = self.strings[n], [], self.root
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(new[node[0]], next(iter(node[1].values())))
        differ = self.values[n] ^ self.values[node]
        if not differ:
            self.equal[node].append(n)
            return
        self.equal[n] = [n]
        depth = self.size - (differ.bit_length() + 7) // 8
        above = None
        for below in path:
            if below[0] >= depth:
                break
            above = below
        else:
            below = node
        if isinstance(below, list) and below[0] == depth:
            below[1][new[depth]] = n
            return
        branch = [depth, {self.strings[node][depth]: below, new[depth]: n}]
        if above is None:
            self.root = branch
        else:
            above[1][new[above[0]]] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """(strings in sorted order, common prefix of each with the one before it; 0 for the first)."""
        order, prefixes, stack = [], [], [(self.root, 0)]
        while stack:
            node, prefix = stack.pop()
            if isinstance(node, list):
                children = [node[1][c] for c in sorted(node[1])]
                stack += [(c, node[0]) for c in reversed(children[1:])]
                stack.append((children[0], prefix))
            else:
                same = self.equal[node]
                order += same
                prefixes += [prefix, *[self.size] * (len(same) - 1)]
        return order, prefixes


def sort_suffixes(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in sorted order, common prefix of each with the one before it) of a byte matrix of padded suffixes."""
    n, size = suffixes.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = suffixes
    order, prefixes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for rows in multikey_quicksort(wide.view(">u8"), SHALLOW):
        end = at + len(rows)
        if len(rows) == 1:
            order[at] = rows[0]
        else:
            inside, prefix = BlindTrie([suffixes[r].tobytes() for r in rows]).ordered()
            order[at:end], prefixes[at:end] = rows[inside], prefix
        if at:
            a, b = suffixes[order[at - 1]], suffixes[order[at]]
            differ = np.flatnonzero(a != b)
            prefixes[at] = differ[0] if len(differ) else size
        at = end
    return order, prefixes
