"""Minimal acyclic transducers: sorted words to their ordinals.

Words come in byte order and are added one by one; what can no longer change is merged with an equal
state at once, so equal suffixes are stored once.  A transition carries the number of words that
come before those behind it, and the sum along a word is its ordinal.  The finished transducer
is a dense table over the bytes that occur, through which all words of a text advance together.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Builder:
    """States of a word list that arrives in strictly ascending byte order."""

    def __init__(self):
        self._frozen: dict[tuple, int] = {}
        self._states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self._path: list[list] = [[False, []]]  # states of the last word: final, edges of [byte, target]
        self._word = b""

    def add(self, word: bytes) -> None:
        if word <= self._word and (self._word or self._path[0][0]):
            raise ValueError("words must ascend")
        same = 0
        while same < min(len(word), len(self._word)) and word[same] == self._word[same]:
            same += 1
        self._freeze(same)
        for byte in word[same:]:
            self._path[-1][1].append([byte, -1])
            self._path.append([False, []])
        self._path[-1][0] = True
        self._word = word

    def _freeze(self, depth: int) -> None:
        """Merges the states of the last word below `depth`."""
        while len(self._path) > depth + 1:
            final, edges = self._path.pop()
            self._path[-1][1][-1][1] = self._intern(final, edges)

    def _intern(self, final: bool, edges: list) -> int:
        key = (final, tuple(map(tuple, edges)))
        if key not in self._frozen:
            self._frozen[key] = len(self._states)
            self._states.append(key)
        return self._frozen[key]

    def finish(self) -> Transducer:
        self._freeze(0)
        root = self._intern(*self._path[0])
        # Targets have smaller numbers than their sources, so one pass counts the words of every state.
        words = np.zeros(len(self._states), np.int64)
        used = sorted({byte for _, edges in self._states for byte, _ in edges})
        column = np.zeros(256, np.int64)
        column[used] = np.arange(1, len(used) + 1)
        target = np.full((len(self._states), len(used) + 1), -1, np.int32)
        before = np.zeros(target.shape, np.int32)
        for i, (final, edges) in enumerate(self._states):
            n = int(final)
            for byte, to in edges:
                target[i, column[byte]], before[i, column[byte]] = to, n
                n += words[to]
            words[i] = n
        final = np.array([f for f, _ in self._states], bool)
        return Transducer(root, column, target, before, final)


class Transducer:
    def __init__(self, root: int, column: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray):
        self.root, self.column, self.target, self.before, self.final = root, column, target, before, final

    @classmethod
    def of(cls, words: Iterable[bytes]) -> Transducer:
        builder = Builder()
        for word in words:
            builder.add(word)
        return builder.finish()

    def ordinals(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The ordinal of each word `data[start:stop]`, -1 where it is not in the list.

        All words advance by one byte at a time; those without a transition drop out.
        """
        out = np.full(len(start), -1, np.int64)
        live = np.arange(len(start))
        at, left = start, stop - start
        state, total = np.full(len(start), self.root), np.zeros(len(start), np.int64)
        while len(live):
            ended = left == 0
            if ended.any():
                done = ended & self.final[state]
                out[live[done]] = total[done]
                go = ~ended
                live, at, left, state, total = live[go], at[go], left[go], state[go], total[go]
            byte = self.column[data[at]]
            to = self.target[state, byte]
            go = to >= 0
            total = (total + self.before[state, byte])[go]
            live, at, left, state = live[go], at[go] + 1, left[go] - 1, to[go]
        return out

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, root=self.root, column=self.column, target=self.target, before=self.before, final=self.final)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as stored:
            return cls(int(stored["root"]), *(stored[n] for n in ("column", "target", "before", "final")))
