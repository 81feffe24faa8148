"""A burst trie of byte strings with two counters per term.

Inner nodes branch on one byte; below them, containers hold the remaining suffixes. A container that grows past
``limit`` bursts into a node with one container per next byte, so only populated regions get deep.
"""

from __future__ import annotations

from collections.abc import Iterator


class BurstTrie:
    __slots__ = ("limit", "root", "size")

    def __init__(self, limit: int = 512):
        self.limit = limit
        self.root: dict = {}  # byte -> node (dict with int keys) or container (_Container)
        self.size = 0

    def add(self, term: bytes, occurrences: int, records: int) -> None:
        """Adds to both counters of a term."""
        node, depth, n = self.root, 0, len(term)
        while True:
            at = term[depth] if depth < n else -1
            child = node.get(at)
            if child is None:
                child = node[at] = _Container()
            if child.__class__ is _Container:
                held = child.get(rest := term[depth + 1 :])
                if held is None:
                    child[rest] = [occurrences, records]
                    self.size += 1
                    if len(child) > self.limit and at >= 0:
                        node[at] = _burst(child)
                else:
                    held[0] += occurrences
                    held[1] += records
                return
            node, depth = child, depth + 1

    def containers(self) -> Iterator[tuple[bytes, dict[bytes, list[int]]]]:
        """(prefix, container) in the order of the prefixes; prefix + suffix is a term."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node.__class__ is _Container:
                yield prefix, node
            else:
                for at in sorted(node, reverse=True):
                    stack.append((prefix + bytes([at]) if at >= 0 else prefix, node[at]))


class _Container(dict):
    __slots__ = ()


def _burst(full: _Container) -> dict:
    node: dict = {}
    for suffix, counters in full.items():
        at = suffix[0] if suffix else -1
        child = node.get(at)
        if child is None:
            child = node[at] = _Container()
        child[suffix[1:]] = counters
    return node
