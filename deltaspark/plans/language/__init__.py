"""A small textual language for iterative programs over rows (key ; value)."""

from .explanation import explain
from .parser import parse
from .run import evaluate
from .session import Session

__all__ = ["Session", "evaluate", "explain", "parse"]
