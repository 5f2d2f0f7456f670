"""An adaptive radix tree over byte keys, with path compression."""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """A layout of few children: their bytes in order, and the children beside them."""

    __slots__ = ("keys", "children", "room")

    def __init__(self, room: int, keys: bytes = b"", children: list | None = None) -> None:
        self.room, self.keys, self.children = room, bytearray(keys), children or []

    def find(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return self.children[at] if at >= 0 else None

    def add(self, byte: int, child: Node) -> Sorted | Indexed:
        """The layout with one more child: this one, or a larger one."""
        if len(self.keys) == self.room:
            if self.room < 16:
                return Sorted(16, self.keys, self.children).add(byte, child)
            return Indexed(self).add(byte, child)
        at = bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.children)


class Indexed:
    """A layout of up to 48 children: for each byte the place of its child."""

    __slots__ = ("places", "children")
    ROOM = 48

    def __init__(self, small: Sorted) -> None:
        self.places, self.children = bytearray(256), list(small.children)
        for place, byte in enumerate(small.keys, 1):
            self.places[byte] = place

    def find(self, byte: int) -> Node | None:
        place = self.places[byte]
        return self.children[place - 1] if place else None

    def add(self, byte: int, child: Node) -> Indexed | Full:
        if len(self.children) == self.ROOM:
            return Full(self).add(byte, child)
        self.children.append(child)
        self.places[byte] = len(self.children)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.children[place - 1]) for byte, place in enumerate(self.places) if place)


class Full:
    """A layout with a place for each byte."""

    __slots__ = ("children",)

    def __init__(self, small: Indexed) -> None:
        self.children: list[Node | None] = [None] * 256
        for byte, child in small.items():
            self.children[byte] = child

    def find(self, byte: int) -> Node | None:
        return self.children[byte]

    def add(self, byte: int, child: Node) -> Full:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class Node:
    """``prefix`` are the bytes between the parent's branch and this one; ``ends`` holds the
    members whose key ends here. A node without children has no layout."""

    __slots__ = ("prefix", "layout", "ends")

    def __init__(self, prefix: bytes, layout: Sorted | Indexed | Full | None = None,
                 ends: list[int] | None = None) -> None:
        self.prefix, self.layout, self.ends = prefix, layout, ends or []


class RadixTree:
    """Members by their keys; many members may share a key, and a key may start another."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, member: int) -> None:
        node, at = self.root, 0
        while True:
            if not key.startswith(node.prefix, at):
                self._cut(node, key[at:at + len(node.prefix)])
            at += len(node.prefix)
            if at == len(key):
                node.ends.append(member)
                return
            child = node.layout.find(key[at]) if node.layout else None
            if child is None:
                added = Node(key[at + 1:], ends=[member])
                node.layout = (node.layout or Sorted(4)).add(key[at], added)
                return
            node, at = child, at + 1

    @staticmethod
    def _cut(node: Node, other: bytes) -> None:
        """End the node's prefix where ``other`` leaves it; what followed becomes a child."""
        size = len(os.path.commonprefix([node.prefix, other]))
        below = Node(node.prefix[size + 1:], node.layout, node.ends)
        node.layout = Sorted(4).add(node.prefix[size], below)
        node.prefix, node.ends = node.prefix[:size], []
