"""Fixpoint loops driven from the driver.

State is a table in the shared folder after every round, so plans don't grow
and a lost executor costs at most one round. Semi-naive loops end when a round
brings nothing new, others when the content is that of the round before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

MOST_ROUNDS = 10_000


class NotConverged(RuntimeError):
    pass


def seminaive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS, key: list[str] | None = None) -> DataFrame:
    """The least set with `seed` that is closed under step; step sees the last round's new rows only.

    key: columns that say whether a row is new; of several new rows of a key in one round the smallest stays.
    """
    key = key or seed.columns
    rest = [c for c in seed.columns if c not in key]

    def one_each(df: DataFrame) -> DataFrame:
        if not rest:
            return df.distinct()
        return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*")

    new = cut(one_each(seed))
    parts = [new]
    for _ in range(rounds):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        new = cut(one_each(step(new).select(*seed.columns)).join(known.select(*key), key, "left_anti"))
        if new.isEmpty():
            return known
        parts.append(new)
        if len(parts) > 8:  # few files to read in later rounds, however many rounds there are
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [cut(whole)]
    raise NotConverged(f"no fixpoint after {rounds} rounds")


def _mark(df: DataFrame) -> tuple:
    """The number of rows and two sums of 64-bit hashes of them: multisets that differ in content differ here."""
    sums = [F.sum(F.xxhash64(F.lit(i), *df.columns).cast("decimal(38,0)")) for i in (1, 2)]
    return tuple(df.agg(F.count(F.lit(1)), *sums).first())


def iterate(source: DataFrame, body: Callable[[DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """x0 = source; x(i+1) = body(x(i)), to a fixpoint or for exactly `rounds` rounds."""
    state = cut(source)
    old = None if rounds is not None else _mark(state)
    for _ in range(rounds if rounds is not None else MOST_ROUNDS):
        state = cut(body(state).select(*source.columns))
        if rounds is None:
            new = _mark(state)
            if new == old:
                return state
            old = new
    if rounds is None:
        raise NotConverged("no fixpoint")
    return state


def variables(start: dict[str, DataFrame], body: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], rounds: int = MOST_ROUNDS) -> dict[str, DataFrame]:
    """Mutual recursion: all variables are replaced at once by what body makes of the last round's."""
    state = {k: cut(v) for k, v in start.items()}
    old = {k: _mark(v) for k, v in state.items()}
    for _ in range(rounds):
        made = body(state)
        state = {k: cut(made[k].select(*v.columns)) for k, v in state.items()}
        new = {k: _mark(v) for k, v in state.items()}
        if new == old:
            return state
        old = new
    raise NotConverged(f"no fixpoint after {rounds} rounds")
