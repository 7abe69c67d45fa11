"""Integer expressions of partition and bucket numbers. All take and give LONG columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig


def network_pid(key: Column, config: JoinConfig = DEFAULT) -> Column:
    """First radix level: the low bits of the key."""
    return key.bitwiseAND(config.network_partitions - 1)


def local_pid(key: Column, config: JoinConfig = DEFAULT) -> Column:
    """Second radix level: the bits above the first."""
    return F.shiftrightunsigned(key, config.network_bits).bitwiseAND(config.local_partitions - 1)


def mod_l1(key: Column, count: int) -> Column:
    return F.pmod(key, F.lit(count).cast("long"))


def mod_l2(key: Column, first: int, second: int) -> Column:
    """Second modulo level; the two levels together are ``key % (first * second)``."""
    return F.pmod(whole(key, first), F.lit(second).cast("long"))


def whole(n: Column, by: int | Column) -> Column:
    """Integer division that stays LONG; of non-negative numbers."""
    return F.call_function("div", n, by if isinstance(by, Column) else F.lit(by).cast("long"))


def next_power_of_two(n: Column) -> Column:
    """Smallest power of two that is at least ``n``; 1 for 0 and 1."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n - 1))))


def chain_bucket(key: Column, buckets: Column, config: JoinConfig = DEFAULT) -> Column:
    """Bucket in a partition's hash table: the key bits above both radix levels, masked to a power of two."""
    return F.shiftrightunsigned(key, config.network_bits + config.local_bits).bitwiseAND(buckets - 1)
