"""Skewed partitions: detection, slices, and the join that deals slices out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from ..functions.bits import network_pid, whole
from .statistics import count_by, dense, exclusive_sum, numbers


def partition_counts(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    return dense(count_by(relation, pid=network_pid(F.col("key"), config)), numbers(relation, config.network_partitions, "pid"))


def skew_blocks(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, blocks``: slices of ``skew_threshold`` rows that a partition needs."""
    return partition_counts(relation, config).select("pid", (whole(F.col("cnt"), config.skew_threshold) + 1).alias("blocks"))


def skew_flags(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, flag``: 0 where a partition is not skewed."""
    return partition_counts(relation, config).select("pid", whole(F.col("cnt"), config.skew_threshold).alias("flag"))


def block_mapping(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``block, pid, ordinal``: every slice of every partition, numbered through."""
    blocks = skew_blocks(relation, config).withColumn("first", exclusive_sum("blocks", [], "pid"))
    return blocks.select("pid", "first", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("ordinal")).select((F.col("first") + F.col("ordinal")).alias("block"), "pid", "ordinal")


def hot_keys(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``key, slices`` of the keys with more than ``hot_rows`` rows; no more rows than the relation has divided by that."""
    counts = relation.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.filter(F.col("cnt") > config.hot_rows).select("key", F.expr(f"(cnt + {config.hot_rows - 1}) div {config.hot_rows}").alias("slices"))


def salted_join(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT, hot: DataFrame | None = None) -> DataFrame:
    """Two relations joined on ``key``. The outer rows of a hot key are dealt at random (by a fixed seed, so equal rows part as well) over the slices that its measured count needs, and only its inner rows are copied to every slice. Without a hot key it is a plain join."""
    hot = hot_keys(outer, config) if hot is None else hot
    if hot.isEmpty():
        return outer.join(inner, "key")
    one = F.coalesce("slices", F.lit(1).cast("long"))
    dealt = outer.join(hot, "key", "left").withColumn("slice", F.floor(F.rand(11) * one)).drop("slices")
    copies = inner.join(hot, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("slices")
    return dealt.join(copies, ["key", "slice"]).drop("slice")


def split_join(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """Partitions of few outer rows joined as they are, hot keys of the skewed ones salted; nothing is left out. The rows are counted by key once, and the partitions' flags are sums of these counts."""
    counts = outer.filter("key is not null").groupBy(network_pid(F.col("key"), config).alias("pid"), "key").agg(F.count(F.lit(1)).alias("cnt"))
    skewed = counts.groupBy("pid").agg(F.sum("cnt").alias("rows")).filter(whole(F.col("rows"), config.skew_threshold) > 0).select("pid")  # a row per partition number
    hot = counts.filter(F.col("cnt") > config.hot_rows).join(F.broadcast(skewed), "pid").select("key", F.expr(f"(cnt + {config.hot_rows - 1}) div {config.hot_rows}").alias("slices"))
    return salted_join(inner, outer, config, hot)
