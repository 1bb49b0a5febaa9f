"""select and transform over streams: both are stateless, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import select
from ..operators.transform import transform


def pipeline(stream: DataFrame, query: dict, spec: dict) -> DataFrame:
    return transform(select(stream, query), spec)


def to_memory(df: DataFrame, name: str) -> StreamingQuery:
    """Run what is there now to an in-memory table (tests)."""
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
