"""Deterministic 64-bit hashing.

Products wrap modulo 2**64, where Spark's longs throw in ANSI mode, so these
are Arrow-batched functions over numpy's unsigned words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# The multipliers of the splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
FIRST = 0xBF58476D1CE4E5B9
SECOND = 0x94D049BB133111EB

_MASK = (1 << 64) - 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = z * np.uint64(GOLDEN)
    z = (z ^ z >> np.uint64(30)) * np.uint64(FIRST)
    z = (z ^ z >> np.uint64(27)) * np.uint64(SECOND)
    return z ^ z >> np.uint64(31)


def hash_u64(x: str | Column) -> Column:
    """The splitmix64 finaliser of x times the golden ratio constant; the unsigned word as a long."""

    @pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(_mix(values.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return run(x)


def gen_row(e: str | Column, nodes: int, arity: int = 2, seed: int = 0) -> Column:
    """Row e of a deterministic random table: `arity` numbers below nodes, as an array."""

    @pandas_udf("array<long>")
    def run(values: pd.Series) -> pd.Series:
        base = values.to_numpy(np.int64).view(np.uint64) * np.uint64(31) + np.uint64(seed * GOLDEN & _MASK)
        fields = [(_mix(base + np.uint64(c)) % np.uint64(nodes)).astype(np.int64) for c in range(arity)]
        return pd.Series(list(np.stack(fields, axis=1)))

    return run(e)


def reference_hash(i: int) -> int:
    """hash_u64 of one number, for tests."""
    z = i * GOLDEN & _MASK
    z = (z ^ z >> 30) * FIRST & _MASK
    z = (z ^ z >> 27) * SECOND & _MASK
    return z ^ z >> 31


def reference_row(e: int, nodes: int, arity: int = 2, seed: int = 0) -> tuple:
    return tuple(reference_hash(31 * e + seed * GOLDEN + c) % nodes for c in range(arity))
