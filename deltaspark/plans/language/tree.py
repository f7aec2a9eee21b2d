"""Programs as trees: scopes hold bindings, feedback variables, child scopes and exports."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Term:
    """A scalar expression: an operation's name and its arguments (terms or constants)."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Node:
    """A collection expression: an operation's name, its input nodes, and what else it needs."""

    op: str
    inputs: tuple = ()
    extra: Any = None


@dataclass
class Scope:
    lets: dict[str, Node] = field(default_factory=dict)
    vars: dict[str, Node] = field(default_factory=dict)
    children: dict[str, Scope] = field(default_factory=dict)
    exports: dict[str, Node] = field(default_factory=dict)


class Variant(tuple):
    """A tagged value: (tag, payload)."""


class Many(tuple):
    """A list value."""


def order(value) -> tuple:
    """Sort key of values: integers, then tuples, tagged values, lists."""
    if isinstance(value, int):
        return (0, value)
    if isinstance(value, Variant):
        return (2, value[0], order(value[1]))
    return (3 if isinstance(value, Many) else 1, tuple(order(x) for x in value))


def sources(scope: Scope) -> tuple[set[int], set[str]]:
    """The positional inputs and imported names that a program reads."""
    inputs, names = set(), set()

    def look(node: Node) -> None:
        if node.op == "input":
            inputs.add(node.extra)
        if node.op == "import":
            names.add(node.extra)
        for x in node.inputs:
            look(x)

    for node in [*scope.lets.values(), *scope.vars.values(), *scope.exports.values()]:
        look(node)
    for child in scope.children.values():
        more = sources(child)
        inputs |= more[0]
        names |= more[1]
    return inputs, names
