"""The expression language: trees, their text, types, and compilation to a panel's columns.

``cs_rank(ts_mean(ts_return(close, 1), 5))`` is a tree of operators, fields and numbers.
Equal sub-trees, of one expression or of a batch, are computed once.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tessera.functions.scalar import finite
from tessera.operators import OPERATORS
from tessera.plans.layers import Panel, Value


@dataclass(frozen=True)
class Node:
    """``kind``: field, number or operator."""

    kind: str
    value: str | float
    children: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return f"{self.value}({', '.join(map(str, self.children))})" if self.kind == "operator" else f"{self.value:g}" if self.kind == "number" else str(self.value)

    @property
    def depth(self) -> int:
        return 1 + max([0, *(c.depth for c in self.children)])

    @property
    def size(self) -> int:
        return 1 + sum(c.size for c in self.children)

    def walk(self, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
        yield path, self
        for i, c in enumerate(self.children):
            yield from c.walk((*path, i))

    def at(self, path: tuple[int, ...]) -> Node:
        return self if not path else self.children[path[0]].at(path[1:])

    def replaced(self, path: tuple[int, ...], new: Node) -> Node:
        if not path:
            return new
        children = list(self.children)
        children[path[0]] = children[path[0]].replaced(path[1:], new)
        return Node(self.kind, self.value, tuple(children))

    @property
    def digest(self) -> str:
        return hashlib.md5(str(self).encode()).hexdigest()

    @property
    def fields(self) -> set[str]:
        return {str(n.value) for _, n in self.walk() if n.kind == "field"}

    @property
    def operators(self) -> set[str]:
        return {str(n.value) for _, n in self.walk() if n.kind == "operator"}

    @property
    def causal(self) -> bool:
        return all(OPERATORS[name].causal for name in self.operators)


def parse(text: str) -> Node:
    """The tree of an expression; raises ValueError for what is none or does not fit the operators' arguments."""
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    node = _node(tree)
    check(node)
    return node


_SIGNS = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div"}


def _node(x: ast.expr) -> Node:
    if isinstance(x, ast.Name):
        return Node("field", x.id)
    if isinstance(x, ast.Constant) and isinstance(x.value, (int, float)):
        return Node("number", float(x.value))
    if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.USub):
        inner = _node(x.operand)
        return Node("number", -float(inner.value)) if inner.kind == "number" else Node("operator", "neg", (inner,))
    if isinstance(x, ast.BinOp) and type(x.op) in _SIGNS:
        return Node("operator", _SIGNS[type(x.op)], (_node(x.left), _node(x.right)))
    if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and not x.keywords:
        return Node("operator", x.func.id, tuple(map(_node, x.args)))
    raise ValueError(f"not part of the language: {ast.dump(x)[:60]}")


def check(node: Node) -> None:
    """Operators must exist and have as many values and numbers as their kinds say."""
    for _, n in node.walk():
        if n.kind != "operator":
            continue
        op = OPERATORS.get(str(n.value))
        if op is None:
            raise ValueError(f"no operator {n.value!r}")
        given = "".join("n" if c.kind == "number" else "v" for c in n.children)
        repeats, values = op.kinds.endswith("V"), sum(k in "vV" for k in op.kinds)
        required, numbers = sum(k.islower() for k in op.kinds), sum(k.islower() and k != "v" for k in op.kinds)
        # a number may stand for a value, a field never for a number
        if len(given) < required or given.count("n") < numbers or not repeats and (len(given) > len(op.kinds) or given.count("v") > values):
            raise ValueError(f"{n.value} takes {op.kinds!r}, not {given!r}")


def build(panel: Panel, node: Node) -> Value:
    """The node's value; equal nodes are one."""
    key = ("node", str(node))
    if key not in panel.memo:
        if node.kind == "field":
            panel.memo[key] = panel.field(str(node.value))
        elif node.kind == "number":
            from pyspark.sql import functions as F

            panel.memo[key] = Value(F.lit(node.value))
        else:
            op = OPERATORS[str(node.value)]
            args = [build(panel, c) if c.kind != "number" or op.kinds[min(i, len(op.kinds) - 1)] in "vV" else int(c.value) if float(c.value).is_integer() else c.value for i, c in enumerate(node.children)]
            panel.memo[key] = op.make(panel, *args)
    return panel.memo[key]


def evaluate(frame: DataFrame, expressions: dict[str, str | Node], *more: str, clean: bool = True) -> DataFrame:
    """(code, t, further columns, one column per expression) over a dense panel; non-finite results are NULL."""
    panel = Panel(frame)
    values = {name: build(panel, parse(e) if isinstance(e, str) else e) for name, e in expressions.items()}
    out = panel.select(values, *more)
    if clean:
        out = out.select(*panel.keys, *more, *(finite(out[n]).alias(n) if dict(out.dtypes)[n] == "double" else n for n in expressions))
    return out


def shared(expressions: Iterable[Node]) -> dict[str, int]:
    """How often each operator sub-tree occurs in a batch, where it does more than once."""
    n: dict[str, int] = {}
    for e in expressions:
        for _, x in e.walk():
            if x.kind == "operator":
                n[str(x)] = n.get(str(x), 0) + 1
    return {k: v for k, v in n.items() if v > 1}
