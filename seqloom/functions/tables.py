"""Table functions for SQL callers."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

HISTORY = 10


class HistoryWindows:
    """For every row but a user's first: the up to ten items before it.

    Called as `history_windows(TABLE(log) PARTITION BY user ORDER BY time)` on rows (uid, event_id, item_id, ...); it keeps ten
    items, not the user's rows.
    """

    def __init__(self):
        self.past = deque(maxlen=HISTORY)

    def eval(self, row: Row):
        if self.past:
            yield row["uid"], row["event_id"], row["item_id"], list(self.past)
        self.past.append(row["item_id"])


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("history_windows", udtf(HistoryWindows, returnType="uid bigint, event_id bigint, item_id bigint, history array<bigint>"))
