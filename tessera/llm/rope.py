"""Ropes: texts as balanced trees of short pieces, cut and joined without copying what stays together.

A leaf holds a piece and its number of units; an inner node caches the units and code points below it.  Trees are never
changed: cutting and joining share subtrees with what they came from and make O(log n) new nodes.  They are
kept in balance by height, as AVL trees are.  Units are matches of a pattern that neither looks before nor after itself.
"""

from __future__ import annotations

import re

#: Units a leaf of a new rope.
LEAF_UNITS = 512
_POINTS = re.compile(r"(?s).")


class Leaf:
    __slots__ = ("text", "units", "points")
    height = 0

    def __init__(self, text: str, units: int):
        self.text, self.units, self.points = text, units, len(text)


class Node:
    __slots__ = ("left", "right", "units", "points", "height")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.height = 1 + max(left.height, right.height)


def build(text: str, unit: re.Pattern | None = None, leaf_units: int = LEAF_UNITS):
    """A rope of ``text`` whose units are the matches of ``unit``, left to right, which must cover the text; None: code
    points.  The empty text is None."""
    if unit is None:
        leaves = [Leaf(text[i : i + leaf_units], min(leaf_units, len(text) - i)) for i in range(0, len(text), leaf_units)]
    else:
        ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
        if (ends[-1] if ends else 0) != len(text):
            raise ValueError("units do not cover the text")
        last = [ends[min(i + leaf_units, len(ends)) - 1] for i in range(0, len(ends), leaf_units)]
        leaves = [Leaf(text[a:b], min(leaf_units, len(ends) - i * leaf_units)) for i, (a, b) in enumerate(zip([0, *last], last))]
    return _tree(leaves) if leaves else None


def _tree(leaves: list):
    half = len(leaves) // 2
    return Node(_tree(leaves[:half]), _tree(leaves[half:])) if half else leaves[0]


def join(left, right):
    """The two ropes one after the other."""
    if left is None or right is None:
        return left or right
    if left.height > right.height + 1:
        return _balanced(left.left, join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(join(left, right.left), right.right)
    return Node(left, right)


def _balanced(left, right):
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def split(rope, rank: int, by: str = "units", unit: re.Pattern | None = None):
    """The first ``rank`` units (or ``by`` "points": code points) of ``rope`` and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if isinstance(rope, Leaf):
        return _cut_leaf(rope, rank, by, unit)
    before = getattr(rope.left, by)
    if rank < before:
        one, other = split(rope.left, rank, by, unit)
        return one, join(other, rope.right)
    if rank > before:
        one, other = split(rope.right, rank - before, by, unit)
        return join(rope.left, one), other
    return rope.left, rope.right


def _cut_leaf(leaf: Leaf, rank: int, by: str, unit: re.Pattern | None):
    """Cuts inside a piece.  A code point inside a unit ends that unit: the part before it counts as one."""
    if unit is None:
        return Leaf(leaf.text[:rank], rank), Leaf(leaf.text[rank:], leaf.units - rank)
    ends = [m.end() for m in unit.finditer(leaf.text) if m.end() > m.start()]
    at = ends[rank - 1] if by == "units" else rank
    before = sum(e <= at for e in ends)
    return Leaf(leaf.text[:at], before + (at not in ends)), Leaf(leaf.text[at:], len(ends) - before)


def pieces(rope) -> list[str]:
    """The texts of the leaves, in order."""
    out, todo = [], [rope] if rope is not None else []
    while todo:
        at = todo.pop()
        if isinstance(at, Leaf):
            out.append(at.text)
        else:
            todo += (at.right, at.left)
    return out
