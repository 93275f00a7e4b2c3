"""Scalar functions over vector columns, for the DataFrame API and, once registered, for SQL."""

from vexel.functions.catalog import FUNCTIONS, call, ensure_registered, expr, register
from vexel.functions.columns import *  # noqa: F403

__all__ = ["FUNCTIONS", "call", "ensure_registered", "expr", "register"]
