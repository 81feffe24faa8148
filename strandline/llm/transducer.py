"""A minimal acyclic transducer: words as byte strings, sharing prefixes and suffixes, with an index as output.

The index is the sum of the outputs on the arcs of a word's path (the words that sort before it), and leads to the
word's ids in one flat table. All parts are plain arrays in one file, which workers map into memory.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence

import numpy as np

_ALIGN = 64


def compile_words(words: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of a transducer for distinct non-empty words with their ids; the order of the words is free."""
    pairs = sorted(words)
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of each finished state: (byte, target)
    final: list[bool] = []
    # The states on the path of the last word that may still grow: [final, [(byte, target)]].
    path: list[list] = [[False, []]]

    def settle(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if (known := register.get(key)) is None:
            known = register[key] = len(arcs)
            arcs.append(state[1])
            final.append(state[0])
        return known

    last = b""
    for word, _ in pairs:
        common = 0
        for a, b in zip(last, word):
            if a != b:
                break
            common += 1
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    root = settle(path[0])

    # States are numbered after their targets, so one pass counts the words below each.
    below = [0] * len(arcs)
    keys, targets, outputs = [], [], []
    for state, own in enumerate(arcs):
        n = int(final[state])
        for byte, target in own:
            keys.append(state << 8 | byte)
            targets.append(target)
            outputs.append(n)
            n += below[target]
        below[state] = n
    ids = [np.asarray(x, np.int32) for _, x in pairs]
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int64)
    parts = [
        np.asarray([root], np.int64),
        np.asarray(keys, np.int64),
        np.asarray(targets, np.int64),
        np.asarray(outputs, np.int64),
        np.asarray(final, np.int8),
        ends,
        np.concatenate(ids) if ids else np.zeros(0, np.int32),
    ]
    out = io.BytesIO()
    out.write(np.asarray([len(p) for p in parts], np.int64).tobytes())
    for p in parts:
        out.write(b"\x00" * (-out.tell() % _ALIGN))
        out.write(p.tobytes())
    return out.getvalue()


_KINDS = (np.int64, np.int64, np.int64, np.int64, np.int8, np.int64, np.int32)


class Transducer:
    """A compiled transducer, mapped into memory from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        sizes = np.frombuffer(data[: 8 * len(_KINDS)], np.int64)
        parts, at = [], 8 * len(_KINDS)
        for n, kind in zip(sizes, _KINDS):
            at += -at % _ALIGN
            size = int(n) * np.dtype(kind).itemsize
            parts.append(data[at : at + size].view(kind))
            at += size
        root, self._keys, self._targets, self._outputs, self._final, self.ends, self.ids = parts
        self._root = int(root[0])

    def index(self, words: Sequence[bytes]) -> np.ndarray:
        """The index of each word, -1 for words that are not there; all words take their steps together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self._keys):
            return found
        lengths = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        who, state, out = np.arange(n), np.full(n, self._root, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(who):
            ended = lengths[who] == step
            if ended.any():
                hit = ended & (self._final[state] == 1)
                found[who[hit]] = out[hit]
                who, state, out = who[~ended], state[~ended], out[~ended]
                if not len(who):
                    break
            key = state << 8 | text[starts[who] + step]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            on = self._keys[at] == key
            at, who = at[on], who[on]
            state, out = self._targets[at], out[on] + self._outputs[at]
            step += 1
        return found
