"""Codec, integer expressions, generators, sinks and the streaming histogram."""

import pytest
from pyspark.sql import functions as F

from joinery.functions import bits, codec
from joinery.operators.join import match_count, packed_match_count
from joinery.plans.metrics import Phases, report, store
from joinery.sources.relations import coprime, modulo_relation, product_mod, shuffled, skewed_relation, unique_relation
from joinery.streaming.histogram import stream_histogram, to_memory


def test_codec_round_trip_to_the_edge_of_its_domain(spark):
    rows = [(k, r) for k in (0, 1, 31, 32, 2**36, 2**37 - 1) for r in (0, 1, 2**27, 2**32 - 1)]
    df = spark.createDataFrame(rows, "key long, rid long")
    assert codec.outside_domain(df).isEmpty()
    assert sorted(map(tuple, codec.decompress(codec.compress(df)).collect())) == sorted(rows)
    beyond = spark.createDataFrame([(2**37, 0), (0, 2**32), (-1, 0)], "key long, rid long")
    assert codec.outside_domain(beyond).count() == 3


def test_packing_outside_the_domain_is_an_error(spark):
    for row in ((2**37, 0), (0, 2**32), (-1, 0), (1, -1)):
        with pytest.raises(Exception, match="packing domain"):
            codec.compress(spark.createDataFrame([row], "key long, rid long")).collect()
    got = codec.compress(spark.createDataFrame([(None, 1), (1, None)], "key long, rid long")).collect()
    assert [r["value"] for r in got] == [None, None]


def test_products_that_a_long_cannot_hold(spark):
    n = 5_000_000_029
    step = coprime(n)
    xs = [0, 1, 12345, n // 2, n - 1]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select("x", product_mod(F.col("x"), step, n).alias("p")).collect()
    assert {r["x"]: r["p"] for r in got} == {x: x * step % n for x in xs}
    first = unique_relation(spark, n, 7).limit(3).collect()
    assert all(7 <= r["key"] < n + 7 for r in first)


def test_packed_count(spark):
    r, s = unique_relation(spark, 500), modulo_relation(spark, 2000, 500)
    assert packed_match_count(r, s).first()["matches"] == match_count(r, s).first()["matches"] == 2000


def test_next_power_of_two(spark):
    got = spark.range(0, 70).select("id", bits.next_power_of_two(F.col("id")).alias("p")).collect()
    assert all(x["p"] == max(1, 1 << max(0, x["id"] - 1).bit_length()) for x in got)


def test_generators(spark):
    for size in (0, 1, 2, 10, 1000):
        keys = sorted(x["key"] for x in unique_relation(spark, size, 5).collect())
        assert keys == list(range(5, 5 + size))
    assert modulo_relation(spark, 0, 3).isEmpty()
    assert shuffled(modulo_relation(spark, 10, 3), 1).collect() != shuffled(modulo_relation(spark, 10, 3), 2).collect()
    hit = skewed_relation(spark, 2000, 100, match_rate=0.5)
    assert 800 < hit.filter("key < 100").count() < 1200
    assert hit.filter("key < 100").groupBy("key").count().agg(F.max("count")).first()[0] > 50


def test_report_and_store(spark, tmp_path):
    phases = Phases()
    with phases.phase("JTOTAL"):
        pass
    phases.note("RESULTS", 7, "tuples")
    both = phases.frame(spark, 0).unionByName(phases.frame(spark, 1))
    got = {r["name"]: r for r in report(both).collect()}
    assert got["RESULTS"]["total"] == 14 and got["RESULTS"]["mean"] == 7 and got["RESULTS"]["runs"] == 2
    store(both, str(tmp_path / "m"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "m")).count() == 4


def test_stream_histogram(spark, tmp_path):
    unique_relation(spark, 640).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, rid long").parquet(str(tmp_path / "in"))
    to_memory(stream_histogram(stream), "hist", str(tmp_path / "state")).awaitTermination()
    assert {(r["pid"], r["cnt"]) for r in spark.table("hist").collect()} == {(p, 20) for p in range(32)}
