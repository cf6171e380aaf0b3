"""Newick text: parsing to (node, parent, name) rows and printing with NHX remarks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\s*(?:([(),;])|'((?:[^']|'')*)'|\[([^\]]*)\]|:\s*([^\s(),;\[\]]+)|([^\s(),;:\[\]']+))")


@dataclass
class Node:
    """A parsed node; ids count from 1 in depth-first order, 0 standing for no species."""

    id: int
    parent: int | None
    name: str = ""
    length: float | None = None
    remarks: dict[str, str] = field(default_factory=dict)
    children: list[int] = field(default_factory=list)


def parse(text: str) -> list[list[Node]]:
    """The trees of a text, each a list of nodes by id, the root first."""
    trees, at, nodes, stack = [], 0, [], []
    current: Node | None = None

    def new(parent: int | None) -> Node:
        n = Node(len(nodes) + 1, parent)
        nodes.append(n)
        if parent:
            nodes[parent - 1].children.append(n.id)
        return n

    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected character at {at}")
        at = m.end()
        sign, quoted, remark, length, plain = m.groups()
        if current is None:
            current = new(None)
        if sign == "(":
            stack.append(current)
            current = new(current.id)
        elif sign == ",":
            if not stack:
                raise ValueError("a comma outside a group")
            current = new(stack[-1].id)
        elif sign == ")":
            if not stack:
                raise ValueError("a group closes that isn't open")
            current = stack.pop()
        elif sign == ";":
            if stack:
                raise ValueError("a group isn't closed")
            trees.append(nodes)
            nodes, current = [], None
        elif remark is not None:
            if remark.startswith("&&NHX"):
                current.remarks |= dict(p.split("=", 1) for p in remark.split(":")[1:] if "=" in p)
        elif length is not None:
            current.length = float(length)
        else:
            current.name = quoted.replace("''", "'") if quoted is not None else plain
    if nodes:
        raise ValueError("a tree doesn't end with ;")
    return trees


def leaf_names(tree: list[Node]) -> list[str]:
    return [n.name for n in tree if not n.children]


def rows(tree: list[Node]) -> list[tuple[int, int | None, str, int, bool]]:
    """(node, parent, name, depth, is_leaf) of each node."""
    depth: dict[int, int] = {}
    out = []
    for n in tree:
        depth[n.id] = 0 if n.parent is None else depth[n.parent] + 1
        out.append((n.id, n.parent, n.name, depth[n.id], not n.children))
    return out


def remark(pairs: dict[str, str]) -> str:
    return "[&&NHX" + "".join(f":{k}={v}" for k, v in pairs.items()) + "]"


def print_tree(tree: list[Node]) -> str:
    """The text of a parsed tree."""

    def one(n: Node) -> str:
        inner = "(" + ",".join(one(tree[c - 1]) for c in n.children) + ")" if n.children else ""
        name = "'" + n.name.replace("'", "''") + "'" if re.search(r"[\s(),;:\[\]']", n.name) else n.name
        return inner + name + ("" if n.length is None else f":{n.length:g}") + (remark(n.remarks) if n.remarks else "")

    return one(tree[0]) + ";"
