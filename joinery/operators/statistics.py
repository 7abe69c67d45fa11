"""Histograms, partition assignment and write offsets.

Counts are partial aggregates, so what is shuffled has at most a row per
partition number and task. Everything after the counts works on tables of one
row per partition (and node); windows over those are small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from ..functions.bits import chain_bucket, local_pid, mod_l1, mod_l2, network_pid, next_power_of_two


def count_by(relation: DataFrame, **columns: Column) -> DataFrame:
    return relation.groupBy(*(c.alias(n) for n, c in columns.items())).agg(F.count(F.lit(1)).alias("cnt"))


def exclusive_sum(value: str, partition: list[str], order: str | Column) -> Column:
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def numbers(relation: DataFrame, count: int, name: str) -> DataFrame:
    return relation.sparkSession.range(count).toDF(name)


def grid_of(df: DataFrame, first: str, rows: int, second: str, columns: int) -> DataFrame:
    return numbers(df, rows, first).select(first, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias(second))


def dense(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts with a zero row for each missing place of the grid."""
    return grid.join(counts, grid.columns, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("long"))


def local_histogram(relation: DataFrame, node: Column, config: JoinConfig = DEFAULT) -> DataFrame:
    """``node, pid, cnt`` of a relation with ``key``."""
    return count_by(relation, node=node, pid=network_pid(F.col("key"), config))


def global_histogram(local: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, cnt`` of every partition, from the nodes' histograms."""
    return dense(local.groupBy("pid").agg(F.sum("cnt").cast("long").alias("cnt")), numbers(local, config.network_partitions, "pid"))


def assignment(df: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, node``: partitions are dealt to nodes in turn."""
    return numbers(df, config.network_partitions, "pid").select("pid", F.pmod("pid", F.lit(config.nodes)).alias("node"))


def base_offsets(local: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, node, base``: where a partition begins in its owner's memory."""
    return global_histogram(local, config).join(assignment(local, config), "pid").select("pid", "node", exclusive_sum("cnt", ["node"], "pid").alias("base"))


def relative_offsets(local: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``node, pid, relative``: rows that lower nodes write before this node into the partition."""
    grid = grid_of(local, "node", config.nodes, "pid", config.network_partitions)
    return dense(local, grid).select("node", "pid", exclusive_sum("cnt", ["pid"], "node").alias("relative"))


def absolute_offsets(local: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``node, pid, absolute``: where a node writes its rows of a partition."""
    base = base_offsets(local, config).select("pid", "base")
    return relative_offsets(local, config).join(base, "pid").select("node", "pid", (F.col("relative") + F.col("base")).alias("absolute"))


def window_sizes(local: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``node, size``: rows that a node owns after the exchange."""
    return global_histogram(local, config).join(assignment(local, config), "pid").groupBy("node").agg(F.sum("cnt").cast("long").alias("size"))


def histogram_computation(inner: DataFrame, outer: DataFrame, node: Column, config: JoinConfig = DEFAULT) -> DataFrame:
    """Everything the exchange needs, per node and partition: owner, both counts and both write offsets. Each side is read once; all but its counts by node and partition are windows over that small table."""
    local = count_by(inner, node=node, pid=network_pid(F.col("key"), config)).withColumn("side", F.lit("inner"))
    local = local.unionByName(count_by(outer, node=node, pid=network_pid(F.col("key"), config)).withColumn("side", F.lit("outer")))
    counts = local.groupBy("node", "pid").agg(*(F.coalesce(F.sum(F.when(F.col("side") == x, F.col("cnt"))), F.lit(0)).alias(x) for x in ("inner", "outer")))
    grid = grid_of(inner, "node", config.nodes, "pid", config.network_partitions)
    full = grid.join(counts, ["node", "pid"], "left").fillna(0, ["inner", "outer"]).withColumn("owner", F.pmod("pid", F.lit(config.nodes)))
    for x in ("inner", "outer"):
        full = full.withColumn(f"{x}_count", F.sum(x).over(Window.partitionBy("pid")).cast("long")).withColumn(f"{x}_before", exclusive_sum(x, ["pid"], "node"))
    for x in ("inner", "outer"):
        full = full.withColumn(f"{x}_offset", exclusive_sum(f"{x}_count", ["node", "owner"], "pid") + F.col(f"{x}_before"))
    return full.select("node", "pid", "inner_offset", "inner_count", "outer_offset", "outer_count", "owner")


def sub_histogram(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, lpid, cnt`` of both radix levels."""
    return count_by(relation, pid=network_pid(F.col("key"), config), lpid=local_pid(F.col("key"), config))


def padded_offsets(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, lpid, offset``: sub-partitions of a partition, each padded to whole lines."""
    grid = grid_of(relation, "pid", config.network_partitions, "lpid", config.local_partitions)
    lines = dense(sub_histogram(relation, config), grid).withColumn("room", F.expr(f"((cnt + {config.pad - 1}) div {config.pad}) * {config.pad}"))
    return lines.select("pid", "lpid", exclusive_sum("room", ["pid"], "lpid").alias("offset"))


def sub_partition_tasks(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, lpid, r_count, s_count`` of the sub-partitions in which both sides have rows."""
    return sub_histogram(inner, config).withColumnRenamed("cnt", "r_count").join(sub_histogram(outer, config).withColumnRenamed("cnt", "s_count"), ["pid", "lpid"])


def modulo_histogram(relation: DataFrame, first: int) -> DataFrame:
    return count_by(relation, p1=mod_l1(F.col("key"), first))


def modulo_histogram_l2(relation: DataFrame, first: int, second: int) -> DataFrame:
    return count_by(relation, p1=mod_l1(F.col("key"), first), p2=mod_l2(F.col("key"), first, second))


def tiled_histogram(relation: DataFrame, first: int, tile: Column) -> DataFrame:
    """The first-level histogram put together from histograms of tiles."""
    tiles = count_by(relation, tile=tile, p1=mod_l1(F.col("key"), first))
    return tiles.groupBy("p1").agg(F.count(F.lit(1)).alias("tiles"), F.sum("cnt").cast("long").alias("cnt"))


def tiled_histogram_l2(relation: DataFrame, first: int, second: int, tile: Column) -> DataFrame:
    """The two-level histogram put together from histograms of tiles."""
    tiles = count_by(relation, tile=tile, p1=mod_l1(F.col("key"), first), p2=mod_l2(F.col("key"), first, second))
    return tiles.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("tiles"), F.sum("cnt").cast("long").alias("cnt"))


def tiled_offsets(relation: DataFrame, first: int, second: int, tile: Column) -> DataFrame:
    """``tile, p1, p2, cnt, base``: where each tile writes its rows when all are laid out by partition, and within a partition tile by tile."""
    tiles = count_by(relation, tile=tile, p1=mod_l1(F.col("key"), first), p2=mod_l2(F.col("key"), first, second))
    sizes = tiles.groupBy("p1", "p2").agg(F.sum("cnt").alias("size"))
    begins = sizes.select("p1", "p2", exclusive_sum("size", [], F.struct("p1", "p2")).alias("begin"))  # a row per partition
    return tiles.join(begins, ["p1", "p2"]).select("tile", "p1", "p2", "cnt", (F.col("begin") + exclusive_sum("cnt", ["p1", "p2"], "tile")).alias("base"))


def partition_ranges(relation: DataFrame, count: int) -> DataFrame:
    """``pid, start, end``: the place of each partition when rows are written partition by partition."""
    counts = dense(count_by(relation, pid=mod_l1(F.col("key"), count)), numbers(relation, count, "pid"))
    return counts.withColumn("start", exclusive_sum("cnt", [], "pid")).select("pid", "start", (F.col("start") + F.col("cnt")).alias("end"))


def bucket_table(relation: DataFrame, buckets: int) -> DataFrame:
    return dense(count_by(relation, bucket=mod_l1(F.col("key"), buckets)), numbers(relation, buckets, "bucket"))


def chain_statistics(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """Per partition, the hash table that the inner side builds and the comparisons that the outer side makes in its chains."""
    pid = network_pid(F.col("key"), config)
    sizes = count_by(inner, pid=pid).select("pid", F.col("cnt").alias("build_rows"), next_power_of_two(F.col("cnt")).alias("buckets"))

    def chains(side: DataFrame, name: str) -> DataFrame:
        # keys first: the join with the partitions' sizes then has a row per key, not per tuple
        keys = side.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("pid", pid).join(sizes, "pid")
        return keys.groupBy("pid", chain_bucket(F.col("key"), F.col("buckets"), config).alias("bucket")).agg(F.sum("n").cast("long").alias(name))

    built = chains(inner, "chain").join(chains(outer, "probes"), ["pid", "bucket"], "left")
    return (
        built.groupBy("pid")
        .agg(F.count(F.lit(1)).alias("used_buckets"), F.max("chain").alias("longest_chain"), F.sum(F.col("chain") * F.coalesce("probes", F.lit(0))).cast("long").alias("comparisons"))
        .join(sizes, "pid")
        .select("pid", "build_rows", "buckets", "used_buckets", "longest_chain", "comparisons")
    )
