"""Operators of the expression language, by name; importing the package registers all of them."""

from tessera.operators import cross, elementwise, grouped, listed, ordered, rolling  # noqa: F401  they register themselves
from tessera.operators.registry import OPERATORS  # noqa: F401
