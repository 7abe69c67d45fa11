"""Inner equi-joins of two relations on one integer key.

``mode`` says how: ``plain`` leaves the strategy to Catalyst and adaptive
execution; ``merge`` and ``shuffle_hash`` force one; ``radix`` and
``two_level`` exchange both sides by key bits, ``modulo`` by the key's remainder,
and merge within the partitions without another exchange; ``salted`` deals hot
keys over slices; ``broadcast`` copies the inner side if it is small enough to
be, and is ``plain`` if not. All give the same rows. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from ..functions.bits import local_pid, network_pid
from ..functions.codec import join_parts
from .partition import estimated_bytes, modulo_exchange, radix_exchange, splits_for
from .skew import salted_join
from .statistics import dense, numbers

MODES = ("plain", "merge", "shuffle_hash", "radix", "two_level", "modulo", "salted", "broadcast")
#: Partitions of the modulo mode.
REMAINDERS = 64


def fits_broadcast(df: DataFrame, rows: int, most: int = DEFAULT.broadcast_bytes) -> bool:
    """Whether a side has at most so many rows and bytes; reads no more than ``rows + 1`` of them."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    fixed = sum(8 if f.name in wide else 16 for f in df.schema)
    if any(f.dataType.typeName() in ("array", "map", "struct", "variant") for f in df.schema):
        known = estimated_bytes(df)  # nested columns are not measured
        if known is None or known > most:
            return False
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in wide), F.lit(fixed).cast("long"))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got["n"] <= rows and got["bytes"] <= most


def equi_join(inner: DataFrame, outer: DataFrame, mode: str = "plain", config: JoinConfig = DEFAULT) -> DataFrame:
    """``key`` and the other columns of ``inner`` and ``outer``, whose only common column is ``key``."""
    if mode == "plain" or mode == "broadcast" and not fits_broadcast(inner, config.broadcast_rows, config.broadcast_bytes):
        return outer.join(inner, "key")
    if mode in ("broadcast", "merge", "shuffle_hash"):
        return outer.join(inner.hint(mode), "key")
    if mode == "salted":
        return salted_join(inner, outer, config)
    sides = [x.filter("key is not null") for x in (inner, outer)]
    if mode == "modulo":
        splits = splits_for(REMAINDERS, config, *sides)
        r, s = (modulo_exchange(x, REMAINDERS, splits=splits) for x in sides)
        places = ["task", "p1"]
    else:
        levels = {"radix": 1, "two_level": 2}[mode]
        places = ["task", "pid", "lpid"][: levels + 1]
        splits = splits_for(config.network_partitions, config, *sides)
        r, s = (radix_exchange(x, config, levels, splits=splits) for x in sides)
    return s.join(r.hint("merge"), [*places, "key"]).drop(*places)


def matched(inner: DataFrame, outer: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``columns`` and ``matches``, whose sums by ``columns`` are the numbers of pairs. No pair is made.

    An inner side that Catalyst would copy to every task is counted by key and looked up by every outer row. Else both
    sides are counted together, with partial counts on the map side: one exchange, no join, and a key moves once a task
    however often it repeats.
    """
    r, s = (x.select(*columns).dropna() for x in (inner, outer))
    threshold = inner.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if (estimated_bytes(r) or threshold + 1) <= threshold:
        return s.join(r.groupBy(*columns).agg(F.count(F.lit(1)).alias("matches")), list(columns))
    sides = r.withColumns({"r": F.lit(1), "s": F.lit(0)}).unionAll(s.withColumns({"r": F.lit(0), "s": F.lit(1)}))
    found = sides.groupBy(*columns).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    return found.filter("r > 0 and s > 0").select(*columns, (F.col("r") * F.col("s")).alias("matches"))


def matches_of(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``key, matches`` of the keys on both sides."""
    return matched(inner, outer, "key").groupBy("key").agg(F.sum("matches").alias("matches"))


def total(matches: DataFrame) -> DataFrame:
    return matches.agg(F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matches"))


def match_count(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``matches``: how many pairs the join has; 0 where a side is empty."""
    return total(matched(inner, outer, "key"))


def packed_match_count(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """The same count over packed tuples, compared by partition and upper half; rows that do not fit are compared by their whole keys."""
    return total(matched(join_parts(inner, config), join_parts(outer, config), "pid", "part", "rest"))


def partition_match_count(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, matches`` of every partition, 0 included."""
    counts = matched(inner, outer, "key").groupBy(network_pid(F.col("key"), config).alias("pid")).agg(F.sum("matches").cast("long").alias("cnt"))
    return dense(counts, numbers(inner, config.network_partitions, "pid")).withColumnRenamed("cnt", "matches")


def two_level_match_count(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``pid, lpid, matches`` of the sub-partitions that have any."""
    places = network_pid(F.col("key"), config).alias("pid"), local_pid(F.col("key"), config).alias("lpid")
    return matched(inner, outer, "key").groupBy(*places).agg(F.sum("matches").cast("long").alias("matches"))


def first_match(inner: DataFrame, outer: DataFrame, value: str, mode: str = "plain", config: JoinConfig = DEFAULT) -> DataFrame:
    """``outer`` rows that match, each with one match: the smallest ``value`` of its key's inner rows. The inner side is reduced by key before it moves; ``mode`` as in ``equi_join``, so that ``broadcast`` probes one table without partitions."""
    return equi_join(inner.groupBy("key").agg(F.min(value).alias(value)), outer, mode, config)


def capped_matches(inner: DataFrame, outer: DataFrame, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` matches of each outer row: the first of its key's inner rows by ``order``. The inner side is cut by key before the join, which so never makes more than ``cap`` rows of one."""
    first = Window.partitionBy("key").orderBy(*order)
    kept = inner.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= cap).drop("place")
    return outer.join(kept, "key")
