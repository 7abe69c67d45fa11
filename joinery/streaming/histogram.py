"""Histograms of a relation that arrives as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, JoinConfig
from ..functions.bits import network_pid


def stream_histogram(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, cnt`` of a streaming relation with ``key``; the state has a row per partition number."""
    return relation.groupBy(network_pid(F.col("key"), config).alias("pid")).agg(F.count(F.lit(1)).alias("cnt"))


def to_memory(histogram: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is there now and keep the counts as the table ``name``."""
    return histogram.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
