"""User sessions kept up to date from a stream of interactions.

State is one row a user: counts and the most recent distinct nodes. A batch gives the same sessions as
operators.users.sessions over all interactions so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.users import SESSION

OUTPUT = "user_id long, session array<long>, interactions long"
STATE = "nodes array<long>, times array<timestamp>, interactions long"


def live_sessions(interactions: DataFrame, late: str = "1 hour", most: int = SESSION) -> DataFrame:
    """Stream (user_id, node_id, at timestamp) -> (user_id, session, interactions) for each user that a trigger touches.
    Rows later than the watermark are dropped; others find their place by time whenever they come."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last: dict[int, pd.Timestamp] = {}
        n = 0
        if state.exists:
            nodes, times, n = state.get
            last = dict(zip(nodes, map(pd.Timestamp, times), strict=True))
        for part in parts:
            n += len(part)
            for node, at in zip(part["node_id"], part["at"], strict=True):
                if node not in last or at > last[node]:
                    last[node] = at
        first = sorted(last.items(), key=lambda kv: (-kv[1].value, kv[0]))[:most]
        state.update(([int(k) for k, _ in first], [v for _, v in first], n))
        yield pd.DataFrame({"user_id": [key[0]], "session": [[int(k) for k, _ in first]], "interactions": [n]})

    timed = interactions.withWatermark("at", late).select("user_id", F.col("node_id").cast("long").alias("node_id"), "at")
    return timed.groupBy("user_id").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


def windowed_activity(interactions: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream (node_id, at) -> interactions of each node in each window, once the watermark has passed it."""
    return interactions.withWatermark("at", late).groupBy(F.window("at", window), "node_id").agg(F.count("*").alias("n")).select("window.start", "window.end", "node_id", "n")
