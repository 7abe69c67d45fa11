"""Exchanges by partition number: radix (low key bits) and modulo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from ..functions.bits import local_pid, mod_l1, mod_l2, network_pid

#: Estimates from here on mean that Catalyst does not know.
UNKNOWN = 1 << 60


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of a table's size, None if it has none; nothing is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else None


def splits_for(partitions: int, config: JoinConfig, *relations: DataFrame) -> int:
    """How many tasks each of so many partitions needs, so that a task of the larger relation gets about ``task_bytes``."""
    most = max((estimated_bytes(x) or 0 for x in relations), default=0)
    return max(1, -(-most // (partitions * config.task_bytes)))


def exchange(relation: DataFrame, place: Column, partitions: int, splits: int = 1, key: str = "key") -> DataFrame:
    """The relation with ``task``, dealt so that rows with one place (below ``partitions``) and key are in one task; a partition has ``splits`` tasks."""
    own = F.pmod(place, F.lit(partitions))
    if splits > 1:
        own = own + F.pmod(F.xxhash64(key), F.lit(splits)) * partitions
    return relation.withColumn("task", F.coalesce(own, F.lit(0)).cast("int")).repartitionById(partitions * splits, "task")


def radix_exchange(relation: DataFrame, config: JoinConfig = DEFAULT, levels: int = 1, key: str = "key", splits: int | None = None) -> DataFrame:
    """The relation with ``pid`` (and ``lpid`` for two levels) and ``task``.

    With one level a task holds a partition, or a share of its keys where the
    relation is larger than ``task_bytes`` times the partitions. Two levels make
    many small partitions, several of which share a task when there are more of
    them than the cluster has use for. Two relations that are to be joined need
    the same ``splits``.
    """
    out, partitions = relation.withColumn("pid", network_pid(F.col(key), config)), config.network_partitions
    place = F.col("pid")
    if splits is None:
        splits = splits_for(partitions, config, relation)
    if levels == 2:
        out = out.withColumn("lpid", local_pid(F.col(key), config))
        place = F.col("lpid") * partitions + F.col("pid")
        wanted = max(splits * partitions, 4 * relation.sparkSession.sparkContext.defaultParallelism)
        shared = min(config.local_partitions, -(-wanted // partitions))
        partitions, splits = partitions * shared, -(-splits // shared)
    return exchange(out, place, partitions, splits, key)


def modulo_exchange(relation: DataFrame, first: int, second: int = 1, config: JoinConfig = DEFAULT, key: str = "key", splits: int | None = None) -> DataFrame:
    """The relation with ``p1`` (and ``p2`` for two levels) and ``task``, dealt by the key's remainders."""
    out = relation.withColumn("p1", mod_l1(F.col(key), first))
    place = F.col("p1")
    if second > 1:
        out = out.withColumn("p2", mod_l2(F.col(key), first, second))
        place = F.col("p1") * second + F.col("p2")
    partitions = first * second
    return exchange(out, place, partitions, splits_for(partitions, config, relation) if splits is None else splits, key)


def conserved(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, declared, written``: a partition's rows by histogram, and by the tasks that got them after the exchange."""
    declared = relation.groupBy(network_pid(F.col("key"), config).alias("pid")).agg(F.count(F.lit(1)).alias("declared"))
    return declared.join(written(radix_exchange(relation, config), config.network_partitions).withColumnRenamed("place", "pid"), "pid", "full")


def written(dealt: DataFrame, partitions: int) -> DataFrame:
    """``place, written``: rows of the tasks that hold each partition."""
    place = F.pmod(F.spark_partition_id(), F.lit(partitions)).cast("long")
    return dealt.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("written"))


def modulo_conserved(relation: DataFrame, first: int, second: int) -> DataFrame:
    """``p1, p2, declared, written`` of a two-level modulo exchange."""
    key = F.col("key")
    declared = relation.groupBy(mod_l1(key, first).alias("p1"), mod_l2(key, first, second).alias("p2")).agg(F.count(F.lit(1)).alias("declared"))
    got = written(modulo_exchange(relation, first, second), first * second)
    place = F.col("place")
    return declared.join(got.select(F.call_function("div", place, F.lit(second)).alias("p1"), F.pmod(place, F.lit(second)).alias("p2"), "written"), ["p1", "p2"], "full")
