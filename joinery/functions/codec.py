"""Packing of a tuple into one LONG, and back.

The packed value holds the row id in its low 32 bits and the key without its
partition bits above them. It is exact for keys under 2^37 and row ids under
2^32; within its partition, equal upper halves mean equal keys. Packing a row
outside that domain is an error, never a wrong value; null keys and row ids give
nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from .bits import network_pid

KEY_SHIFT = 32


def packed(key: Column, rid: Column, config: JoinConfig = DEFAULT) -> Column:
    return rid + F.shiftleft(F.shiftrightunsigned(key, config.network_bits), KEY_SHIFT)


def key_part(value: Column) -> Column:
    return F.shiftrightunsigned(value, KEY_SHIFT)


def unpacked_key(value: Column, pid: Column, config: JoinConfig = DEFAULT) -> Column:
    return F.shiftleft(key_part(value), config.network_bits) + pid


def unpacked_rid(value: Column) -> Column:
    return value.bitwiseAND((1 << KEY_SHIFT) - 1)


def inside_domain(key: Column, rid: Column, config: JoinConfig = DEFAULT) -> Column:
    """Whether packing is exact; null for null keys and row ids."""
    return (key >= 0) & (key < 1 << (32 + config.network_bits)) & (rid >= 0) & (rid < 1 << KEY_SHIFT)


def join_parts(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, part, rest``: what two rows of a relation (key, rid) have in common if and only if their keys are equal. ``part`` is the upper half of the packed value; rows outside the domain take it from the key itself, and ``rest`` is what is left of the key above it."""
    key, rid = F.col("key"), F.col("rid")
    own = F.shiftrightunsigned(key, config.network_bits).bitwiseAND((1 << 32) - 1)
    part = F.when(inside_domain(key, rid, config), key_part(packed(key, rid, config))).otherwise(own)
    return relation.select(network_pid(key, config).alias("pid"), part.alias("part"), F.shiftright(key, 32 + config.network_bits).alias("rest"))


def compress(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, value`` of a relation (key, rid); an error for rows outside the domain (see ``outside_domain``)."""
    key, rid = F.col("key"), F.col("rid")
    checked = F.when(inside_domain(key, rid, config), packed(key, rid, config)).when(key.isNotNull() & rid.isNotNull(), F.raise_error(F.lit("key or rid outside the packing domain")).cast("long"))
    return relation.select(network_pid(key, config).alias("pid"), checked.alias("value"))


def decompress(tuples: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``key, rid`` of packed tuples (pid, value)."""
    return tuples.select(unpacked_key(F.col("value"), F.col("pid"), config).alias("key"), unpacked_rid(F.col("value")).alias("rid"))


def outside_domain(relation: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """Rows that packing would not give back."""
    return relation.filter(~inside_domain(F.col("key"), F.col("rid"), config))
