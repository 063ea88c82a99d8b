"""A minimal acyclic transducer from words to id sequences, in one file that workers memory-map.

States with equal futures are one state, so words share suffixes as well as
prefixes. Arcs carry numbers; those along a word's path add up to the word's
rank among all words, which leads to its ids.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

MAGIC = b"TIDELEX1"
HEAD = "<8sQQQQ"


class Builder:
    """Takes distinct words in ascending order of their bytes; merges equal states as soon as no word can change them."""

    def __init__(self):
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.register: dict[tuple, int] = {}
        self.path: list[int] = [0]  # states along the last word
        self.last = b""

    def add(self, word: bytes) -> None:
        shared = 0
        while shared < len(word) and shared < len(self.last) and word[shared] == self.last[shared]:
            shared += 1
        self.settle(shared)
        for byte in word[shared:]:
            self.arcs.append({})
            self.final.append(False)
            self.arcs[self.path[-1]][byte] = len(self.arcs) - 1
            self.path.append(len(self.arcs) - 1)
        self.final[self.path[-1]] = True
        self.last = word

    def settle(self, depth: int) -> None:
        """Replace the states below ``depth`` by equal ones that are known already."""
        for at in range(len(self.path) - 1, depth, -1):
            state = self.path.pop()
            known = self.register.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
            self.arcs[self.path[-1]][self.last[at - 1]] = known

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arc keys (state * 256 + byte, ascending), targets, numbers, and which states are final."""
        self.settle(0)
        order, words, stack = {0: 0}, {}, [(0, False)]
        while stack:  # words below each state, children first
            state, done = stack.pop()
            if done:
                words[state] = self.final[state] + sum(words[t] for t in self.arcs[state].values())
            elif state not in words:
                order.setdefault(state, len(order))
                stack.append((state, True))
                stack += [(t, False) for t in self.arcs[state].values() if t not in words]
        keys, targets, numbers = [], [], []
        for state, new in sorted(order.items(), key=lambda x: x[1]):
            before = int(self.final[state])
            for byte, target in sorted(self.arcs[state].items()):
                keys.append(new * 256 + byte)
                targets.append(order[target])
                numbers.append(before)
                before += words[target]
        final = np.zeros(len(order), np.uint8)
        for state, new in order.items():
            final[new] = self.final[state]
        return np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(numbers, "<i8"), final


def compile_lexicon(entries: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file for ``entries`` (distinct non-empty words and their ids)."""
    entries = sorted(entries, key=lambda e: e[0])
    builder = Builder()
    for word, _ in entries:
        builder.add(word)
    keys, targets, numbers, final = builder.arrays()
    offsets = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries])]).astype("<i8")
    ids = np.array([i for _, found in entries for i in found], "<u4")
    parts = [keys, targets, numbers, offsets, ids, final]
    return struct.pack(HEAD, MAGIC, len(keys), len(final), len(entries), len(ids)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The compiled file, memory-mapped: workers of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            magic, arcs, states, words, ids = struct.unpack(HEAD, file.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        at = struct.calcsize(HEAD)

        def mapped(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            array = np.memmap(path, dtype, "r", at, (n,)) if n else np.empty(0, dtype)
            at += array.nbytes
            return array

        self.keys, self.targets, self.numbers = (mapped("<i8", arcs) for _ in range(3))
        self.offsets, self.ids, self.final = mapped("<i8", words + 1), mapped("<u4", ids), mapped("u1", states)

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that are not in the lexicon. All words walk at once, a byte per step."""
        found = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        alive = np.flatnonzero(lengths > 0)
        state, rank, step = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64), 0
        while len(alive) and len(self.keys):
            wanted = state * 256 + data[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            fits = self.keys[arc] == wanted
            alive, arc = alive[fits], arc[fits]
            state, rank, step = self.targets[arc], rank[fits] + self.numbers[arc], step + 1
            ends = lengths[alive] == step
            accepted = ends & (self.final[state] == 1)
            found[alive[accepted]] = rank[accepted]
            alive, state, rank = alive[~ends], state[~ends], rank[~ends]
        return found

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]]
