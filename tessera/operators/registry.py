"""The registry: each operator's name, function, argument kinds, and whether it looks ahead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    """``kinds``: one letter per argument, v a value, d a number of rows, q a quantile, e an exponent, n another number; upper case: may be left out."""

    name: str
    make: Callable
    kinds: str
    causal: bool = True
    search: bool = False  # takes part in expression search
    grouped: bool = False  # computed by a Python kernel per group

    @property
    def values(self) -> int:
        return self.kinds.lower().count("v")


OPERATORS: dict[str, Operator] = {}


def operator(kinds: str, *names: str, causal: bool = True, search: bool = False, grouped: bool = False):
    """Registers a function (panel, *arguments) -> Value under its own and further names."""

    def register(make: Callable) -> Callable:
        for name in names or (make.__name__,):
            OPERATORS[name] = Operator(name, make, kinds, causal, search, grouped)
        return make

    return register
