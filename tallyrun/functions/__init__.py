"""Expressions and scalar functions."""

from .expr import Expr, ExprError, cast, col, isnull, lit, parse, quadkey

__all__ = ["Expr", "ExprError", "cast", "col", "isnull", "lit", "parse", "quadkey"]
