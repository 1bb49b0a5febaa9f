"""Merge over a stream: the merged document of each key is kept as state and expires.

Rows are merged in order of a column inside a trigger, and triggers in order of arrival, by the rules of deep merge. The state of a
key is its merged value as JSON text; only the keys of a trigger's rows are read and written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import trees
from ..session import ship


def merge_stream(stream: DataFrame, by: str, order: str, doc: str, expire_ms: int | None = None) -> DataFrame:
    """by (text) and doc (JSON text) of the keys that a trigger's rows touched, with all that was merged so far (update mode).

    expire_ms: a key without rows for so long (processing time) is forgotten and begins anew; None keeps it (Spark then runs triggers without
    data too, unless spark.sql.streaming.noDataMicroBatches.enabled is false). Absent documents are left out; null keys are
    a key; rows of equal order are merged by their text.
    """
    ship(stream.sparkSession)
    rows = stream.select(F.col(by).cast("string").alias("key"), F.col(order).alias("at"), F.to_json(doc).alias("text")).where("text is not null")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        merged = [json.loads(state.get[0])] if state.exists else []
        # a trigger's rows of one key, in order
        frame = pd.concat(list(parts)).sort_values(["at", "text"], kind="stable")
        for text in frame["text"]:
            merged = [trees.merge([*merged, json.loads(text)])]
        text = json.dumps(merged[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        state.update((text,))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({by: [key[0]], doc: [text]})

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(fold, f"`{by}` string, `{doc}` string", "text string", "update", timeout)
