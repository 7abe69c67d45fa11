"""Relations: tables of a folder, and generated ones of (key, rid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import whole


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_relation(df: DataFrame, key: str, rid: str) -> DataFrame:
    """Two columns of a table as key and row id."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(rid).cast("long").alias("rid"))


def unique_relation(spark: SparkSession, size: int, start_key: int = 0, start_rid: int = 0) -> DataFrame:
    """Every key of ``size`` in a row once. Keys are dealt to row ids by a bijection that mixes them, so neither is in the other's order."""
    step, n = coprime(size), max(1, size)
    at = F.col("id").cast("long")
    if size * step + size >= 1 << 63:  # id * step is taken apart, so that no product leaves a LONG
        if size >= 1 << 47:
            raise ValueError("a unique relation has fewer than 2^47 rows")
        at = product_mod(at, step, n)
    else:
        at = F.pmod(at * step, F.lit(n))
    return spark.range(size).select((F.pmod(at + size // 2, F.lit(n)) + start_key).alias("key"), (F.col("id") + start_rid).alias("rid"))


def product_mod(x: Column, step: int, n: int) -> Column:
    """``x * step`` modulo ``n`` for x and step below n < 2^47, by digits of 16 bits of the step, highest first."""
    out = F.lit(0).cast("long")
    for shift in (32, 16, 0):
        out = F.pmod(F.pmod(out * (1 << 16), F.lit(n)) + F.pmod(x * (step >> shift & 0xFFFF), F.lit(n)), F.lit(n))
    return out


def coprime(size: int) -> int:
    """A step near the golden section of ``size`` that visits every number below it."""
    from math import gcd

    step = max(1, int(size * 0.6180339887))
    while gcd(step, max(1, size)) != 1:
        step += 1
    return step


def modulo_relation(spark: SparkSession, size: int, inner_size: int, start_key: int = 0, start_rid: int = 0) -> DataFrame:
    """Keys that repeat every ``inner_size`` rows, as a foreign key does."""
    return spark.range(size).select((F.pmod("id", F.lit(inner_size)) + start_key).alias("key"), (F.col("id") + start_rid).alias("rid"))


def skewed_relation(spark: SparkSession, size: int, inner_size: int, exponent: float = 1.0, match_rate: float = 1.0, seed: int = 1234) -> DataFrame:
    """Keys by a power law over ``inner_size``; a share ``1 - match_rate`` of the rows gets keys beyond it."""
    u = F.rand(seed)
    key = F.least(F.floor(F.pow(F.lit(float(inner_size)), F.pow(u, F.lit(max(exponent, 1e-9))))) - 1, F.lit(inner_size - 1)).cast("long")
    return spark.range(size).select(F.when(F.rand(seed + 1) < match_rate, key).otherwise(key + inner_size).alias("key"), F.col("id").alias("rid"))


def power_law_relation(spark: SparkSession, size: int, inner_size: int, match_percent: int = 100) -> DataFrame:
    """Keys by a power law without random numbers: row i has key floor(inner_size / (i % inner_size + 1)), so half of the keys' range has one row in a round and key 1 half the round; of every 100 rows, the first ``match_percent`` have keys within ``inner_size`` and the others beyond."""
    key = whole(F.lit(inner_size).cast("long"), F.pmod("id", F.lit(inner_size)) + 1)
    return spark.range(size).select((key + F.when(F.pmod("id", F.lit(100)) < match_percent, 0).otherwise(inner_size)).alias("key"), F.col("id").alias("rid"))


def shuffled(relation: DataFrame, seed: int = 1234) -> DataFrame:
    """The rows in a random order that the seed fixes."""
    return relation.orderBy(F.xxhash64(*relation.columns, F.lit(seed)), *relation.columns)


def distributed(relation: DataFrame, nodes: int) -> DataFrame:
    """Rows dealt evenly over ``nodes`` partitions, whatever their keys."""
    return relation.repartition(nodes)


def node_of(rid: Column, nodes: int) -> Column:
    """The node that a row of a table counts for."""
    return F.pmod(rid, F.lit(nodes)).cast("long")
