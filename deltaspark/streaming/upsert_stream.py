"""Upserts as a stateful stream: the value held for each key is the operator's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def upserts(events: DataFrame) -> DataFrame:
    """Changes (key, val, time, w) from a stream of events (key string, val string, time long).

    A null val deletes; of several events of a key at one time the greatest val wins.
    Events of a key have to arrive in the order of their times over micro-batches: one that isn't later than
    the key's last is an error. For that a deleted key keeps its last time, and nothing else.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        held, last = state.get if state.exists else (None, None)
        if last is not None and rows["time"].min() <= last:
            raise ValueError(f"an event of {key[0]} at {rows['time'].min()} comes after one at {last}")
        out = []
        for time, same in rows.groupby("time", sort=True):
            values = [v for v in same["val"] if v is not None]
            new = max(values) if values else None
            if new != held:
                if held is not None:
                    out.append((key[0], held, time, -1))
                if new is not None:
                    out.append((key[0], new, time, 1))
                held = new
        state.update((held, int(rows["time"].max())))
        yield pd.DataFrame(out, columns=["key", "val", "time", "w"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, val string, time long, w long", "val string, time long", "append", GroupStateTimeout.NoTimeout)
