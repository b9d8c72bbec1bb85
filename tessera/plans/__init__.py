"""Logical layer: the panel, layered windows, the expression language and what is built on them."""
