"""Phase timings of a run, their report and sinks."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, JoinConfig
from ..operators import statistics
from ..operators.join import match_count, matches_of
from ..operators.partition import radix_exchange
from ..operators.statistics import histogram_computation, local_histogram
from ..sources.relations import node_of


class Phases:
    """Microseconds and counts by name. Names are fixed values: JTOTAL the whole, JHIST histograms, JMPI exchange, JPROC local join, RESULTS matches."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, int((time.perf_counter() - start) * 1e6), "us"))

    def note(self, name: str, value: int, unit: str) -> None:
        self.rows.append((name, value, unit))

    def frame(self, spark: SparkSession, run: int = 0) -> DataFrame:
        return spark.createDataFrame([(run, *r) for r in self.rows], "run int, name string, value long, unit string")


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed_run(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> Phases:
    """Run and time histograms, exchange and join of two relations (key, rid)."""
    phases = Phases()
    with phases.phase("JTOTAL"):
        with phases.phase("JHIST"):
            noop(histogram_computation(inner, outer, node_of(F.col("rid"), config.nodes), config))
        with phases.phase("JMPI"):
            noop(radix_exchange(inner, config))
            noop(radix_exchange(outer, config))
        with phases.phase("JPROC"):
            found = match_count(inner, outer).first()
    phases.note("RESULTS", found["matches"] if found else 0, "tuples")
    return phases


def timed_phases(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> Phases:
    """The parts of a run, each by itself. Fixed names: HILOCAL and HOLOCAL the local histograms of both sides, HIGLOBAL and HOGLOBAL the global ones, HASSIGN the assignment, HIOFFCOMP and HOOFFCOMP the offsets, MIMAINPART and MOMAINPART the exchanges alone, LPHISTCOMP and LPOFFSET the second level's histogram and offsets, LPPART its exchange, BPBUILD the table of the inner side alone, BPPROBE the matches by key.

    What a machine's own clock, windows or memory pool would tell has no counterpart in Spark and is left out.
    """
    phases, node = Phases(), node_of(F.col("rid"), config.nodes)
    with phases.phase("JTOTAL"):
        for x, side in (("I", inner), ("O", outer)):
            local = local_histogram(side, node, config)
            for name, made in ((f"H{x}LOCAL", local), (f"H{x}GLOBAL", statistics.global_histogram(local, config)), (f"H{x}OFFCOMP", statistics.absolute_offsets(local, config)), (f"M{x}MAINPART", radix_exchange(side, config))):
                with phases.phase(name):
                    noop(made)
        for name, made in (
            ("HASSIGN", statistics.assignment(inner, config)),
            ("LPHISTCOMP", statistics.sub_histogram(outer, config)),
            ("LPOFFSET", statistics.padded_offsets(outer, config)),
            ("LPPART", radix_exchange(outer, config, 2)),
            ("BPBUILD", statistics.bucket_table(inner, config.buckets)),
            ("BPPROBE", matches_of(inner, outer)),
        ):
            with phases.phase(name):
                noop(made)
    return phases


def counters(inner: DataFrame, outer: DataFrame, config: JoinConfig = DEFAULT) -> DataFrame:
    """``name, value, unit`` of what a run counts. Fixed names: HILOCELEM and HOLOCELEM tuples of both sides, LPTASKCOUNT and LPELEMENTS partitions and tuples of the second level, BPTASKCOUNT its tasks with tuples on both sides, BPBUILDELEM and BPPROBEELEM tuples built and probed, RESULTS matches."""
    r, s = (statistics.sub_histogram(x, config).withColumnRenamed("cnt", n) for x, n in ((inner, "r"), (outer, "s")))
    sums = r.join(s, ["pid", "lpid"], "full").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("r", "s")), F.count(F.when(F.col("r").isNotNull() & F.col("s").isNotNull(), 1)).alias("both"))
    row = sums.join(match_count(inner, outer), how="cross")  # one row on either side
    r, s = F.col("r"), F.col("s")
    values = [("HILOCELEM", r, "tuples"), ("HOLOCELEM", s, "tuples"), ("LPTASKCOUNT", F.lit(config.network_partitions).cast("long"), "tasks"), ("LPELEMENTS", r + s, "tuples"), ("BPTASKCOUNT", F.col("both"), "tasks"), ("BPBUILDELEM", r, "tuples"), ("BPPROBEELEM", s, "tuples"), ("RESULTS", F.col("matches"), "tuples")]
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(u).alias("unit")) for n, v, u in values))))


def report(metrics: DataFrame) -> DataFrame:
    """``name, unit, runs, total, mean`` over runs."""
    return metrics.groupBy("name", "unit").agg(F.countDistinct("run").alias("runs"), F.sum("value").alias("total"), F.floor(F.avg("value")).alias("mean"))


def store(metrics: DataFrame, path: str) -> None:
    """Tab-separated files of name, value and unit, a folder per run."""
    metrics.select("run", "name", "value", "unit").write.partitionBy("run").option("sep", "\t").mode("overwrite").csv(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``store`` wrote: ``run, name, value, unit``."""
    return spark.read.schema("name string, value long, unit string, run int").option("sep", "\t").csv(path).select("run", "name", "value", "unit")
