"""Static lookup structures over numpy arrays, searched for many keys at once and mappable from a file.

`IntMap` is an open hash table. `Transducer` is a minimal acyclic automaton over bytes: states with
equal continuations are shared, and every transition has a number; the numbers along a word add up
to the rank of the word, by which its outputs are found."""

import mmap
import os

import numpy as np

from reportlake.llm.work import hidden_file

ODD = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """From non-negative 62-bit keys to rows."""

    def __init__(self, slots: np.ndarray, rows: np.ndarray) -> None:
        self.slots, self.rows = slots, rows
        self.shift = np.uint64(64 - (len(slots).bit_length() - 1))

    @classmethod
    def build(cls, keys: np.ndarray) -> "IntMap":
        size = 1 << max(4, (4 * len(keys)).bit_length())
        out = cls(np.full(size, -1, np.int64), np.zeros(size, np.int32))
        left = np.arange(len(keys))
        at = out.home(keys)
        while len(left):
            free = out.slots[at[left]] < 0
            out.slots[at[left[free]]] = keys[left[free]]
            placed = free & (out.slots[at[left]] == keys[left])
            out.rows[at[left[placed]]] = left[placed]
            left = left[~placed]
            at[left] = (at[left] + 1) & (size - 1)
        return out

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key, -1 where absent."""
        at = self.home(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.rows[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def _minimal(words: list[bytes]) -> list[tuple[bool, list[tuple[int, int]]]]:
    """States (final, transitions) of the minimal automaton of sorted distinct words; the root is last.

    The word list is read once: what can no longer change is replaced by an equal known state."""
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]
    letters = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in known:
                known[key] = len(states)
                states.append((final, edges))
            path[-1][1].append((letters[len(path) - 1], known[key]))

    for word in words:
        close(len(os.path.commonprefix([letters, word])))
        path.extend([False, []] for _ in range(len(word) + 1 - len(path)))
        path[-1][0] = True
        letters = word
    close(0)
    states.append((path[0][0], path[0][1]))
    return states


class Transducer:
    NAMES = ("slots", "rows", "target", "number", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        self.edges = IntMap(arrays["slots"], arrays["rows"])
        self.target, self.number, self.final = arrays["target"], arrays["number"], arrays["final"]
        self.first, self.ids = arrays["first"], arrays["ids"]
        self.root = len(self.final) - 1

    @classmethod
    def build(cls, words: list[bytes], outputs: list[list[int]]) -> "Transducer":
        """`words` sorted and distinct; outputs[i] belongs to words[i]."""
        states = _minimal(words)
        below, keys, target, number = [], [], [], []
        for state, (final, edges) in enumerate(states):
            total = int(final)
            for byte, to in edges:
                keys.append(state << 8 | byte)
                target.append(to)
                number.append(total)
                total += below[to]
            below.append(total)
        table = IntMap.build(np.array(keys, np.int64))
        return cls({
            "slots": table.slots, "rows": table.rows, "target": np.array(target, np.int32),
            "number": np.array(number, np.int32), "final": np.array([f for f, _ in states], np.int8),
            "first": np.cumsum([0, *map(len, outputs)]).astype(np.int32),
            "ids": np.array([i for out in outputs for i in out], np.int32),
        })

    def rank(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rank of data[start:end] for every span, -1 for unknown words."""
        state = np.full(len(starts), self.root, np.int64)
        total = np.zeros(len(starts), np.int64)
        at, alive = starts.astype(np.int64), np.flatnonzero(ends > starts)
        while len(alive):
            edge = self.edges.find(state[alive] << 8 | data[at[alive]])
            ok = edge >= 0
            state[alive[~ok]] = -1
            alive, edge = alive[ok], edge[ok]
            state[alive] = self.target[edge]
            total[alive] += self.number[edge]
            at[alive] += 1
            alive = alive[at[alive] < ends[alive]]
        known = state >= 0
        known[known] = self.final[state[known]] == 1
        return np.where(known, total, -1)

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(self.arrays[n]).tobytes() for n in self.NAMES]
        head = np.array([(len(self.arrays[n]), self.arrays[n].itemsize) for n in self.NAMES], np.int64).tobytes()
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, blob: bytes) -> "Transducer":
        """Over a memory-mapped file without a name, as shared by all readers of this process."""
        handle = hidden_file()
        with os.fdopen(handle, "wb", closefd=True) as file:
            file.write(blob)
            file.flush()
            view = mmap.mmap(file.fileno(), len(blob), access=mmap.ACCESS_READ)
        head = np.frombuffer(view, np.int64, 2 * len(cls.NAMES)).reshape(-1, 2)
        at, arrays = head.nbytes, {}
        for name, (n, width) in zip(cls.NAMES, head.tolist()):
            arrays[name] = np.frombuffer(view, f"<i{width}", n, at)
            at += n * width + -(n * width) % 8
        return cls(arrays)
