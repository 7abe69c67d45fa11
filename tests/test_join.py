"""All join modes give the same bag of rows, on inputs that break careless joins."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joinery.config import JoinConfig
from joinery.operators import join, partition, skew, statistics
from joinery.sources.relations import skewed_relation, unique_relation


def sides(spark, inner, outer):
    return spark.createDataFrame(inner, "key long, r_rid long"), spark.createDataFrame(outer, "key long, s_rid long")


def expected(inner, outer):
    return Counter((k, s, r) for k, s in outer if k is not None for key, r in inner if key == k)


CASES = {
    "empty inner": ([], [(1, 1), (2, 2)]),
    "empty outer": ([(1, 1)], []),
    "no common key": ([(1, 1)], [(2, 2)]),
    "duplicates on both sides": ([(1, 1), (1, 2), (33, 3)], [(1, 4), (1, 5), (33, 6), (33, 6)]),
    "nulls": ([(None, 1), (1, 2)], [(None, 3), (1, 4), (None, 5)]),
    "wide keys": ([(5, 1), (5 + 2**37, 2), (2**62, 3)], [(5, 4), (5 + 2**37, 5), (2**62, 6)]),
    "wide rids": ([(7, 2**27), (7, 2**40)], [(7, 2**33)]),
    "hot key": ([(3, 1), (4, 2)], [(3, i) for i in range(400)] + [(4, i) for i in range(100)]),
}


@pytest.mark.parametrize("mode", join.MODES)
@pytest.mark.parametrize("case", sorted(CASES))
def test_modes_agree(spark, mode, case):
    inner, outer = CASES[case]
    r, s = sides(spark, inner, outer)
    got = Counter(tuple(x) for x in join.equi_join(r, s, mode).select("key", "s_rid", "r_rid").collect())
    assert got == expected(inner, outer)


@pytest.mark.parametrize("case", sorted(CASES))
def test_counts_agree(spark, case):
    inner, outer = CASES[case]
    r, s = sides(spark, inner, outer)
    want = sum(expected(inner, outer).values())
    assert join.match_count(r, s).first()["matches"] == want
    assert join.partition_match_count(r, s).agg(F.sum("matches")).first()[0] == want
    assert join.partition_match_count(r, s).count() == 32
    as_rid = lambda df: df.toDF("key", "rid")
    assert join.packed_match_count(as_rid(r), as_rid(s)).first()["matches"] == want
    assert join.two_level_match_count(r, s).agg(F.coalesce(F.sum("matches"), F.lit(0))).first()[0] == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=30), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9)), max_size=30))
def test_radix_join_of_any_rows(spark, inner, outer):
    r, s = sides(spark, inner, outer)
    got = Counter(tuple(x) for x in join.equi_join(r, s, "radix").select("key", "s_rid", "r_rid").collect())
    assert got == expected(inner, outer)


def test_capped_and_first_matches(spark):
    r, s = sides(spark, [(1, i) for i in range(20)] + [(2, 5)], [(1, 100), (2, 200), (3, 300)])
    capped = join.capped_matches(r, s, ["r_rid"], 8).collect()
    assert Counter(x["key"] for x in capped) == {1: 8, 2: 1}
    assert sorted((x["key"], x["r_rid"]) for x in join.first_match(r, s, "r_rid").collect()) == [(1, 0), (2, 5)]


def test_a_side_too_large_is_not_broadcast(spark):
    r, s = sides(spark, [(i, i) for i in range(50)], [(i, i) for i in range(50)])
    assert not join.fits_broadcast(r, 49) and join.fits_broadcast(r, 50)
    assert join.equi_join(r, s, "broadcast", JoinConfig(broadcast_rows=10)).count() == 50


@pytest.mark.parametrize("most", ["-1", "10m"])
def test_counts_of_written_tables(spark, tmp_path, most):
    for name, size in (("r", 3000), ("s", 9000)):
        skewed_relation(spark, size, 500, match_rate=0.8).write.parquet(str(tmp_path / name))
    r, s = (spark.read.parquet(str(tmp_path / x)) for x in ("r", "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        counted = join.match_count(r, s)
        assert ("HashJoin" in counted._jdf.queryExecution().executedPlan().toString()) == (most != "-1")
        assert counted.first()["matches"] == join.packed_match_count(r, s).first()["matches"] == r.join(s, "key").count()
        assert {tuple(x) for x in join.matches_of(r, s).collect()} == {tuple(x) for x in r.join(s, "key").groupBy("key").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_match_by_broadcast(spark):
    r, s = sides(spark, [(1, i) for i in range(20)] + [(2, 5)], [(1, 100), (1, 100), (2, 200), (3, 300), (None, 4)])
    got = join.first_match(r, s, "r_rid", "broadcast")
    assert sorted((x["key"], x["s_rid"], x["r_rid"]) for x in got.collect()) == [(1, 100, 0), (1, 100, 0), (2, 200, 5)]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_a_side_of_many_bytes_is_not_broadcast(spark):
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "key long, r_rid string")
    assert join.fits_broadcast(wide, 50) and not join.fits_broadcast(wide, 50, 40_000)


@pytest.mark.parametrize("mode", ["radix", "two_level", "modulo"])
def test_more_bytes_give_more_tasks_and_the_same_rows(spark, tmp_path, mode):
    for name, size in (("r", 3000), ("s", 9000)):
        skewed_relation(spark, size, 500, match_rate=0.8).write.parquet(str(tmp_path / name))
    r, s = (spark.read.parquet(str(tmp_path / x)).withColumnRenamed("rid", f"{x}_rid") for x in ("r", "s"))
    config = JoinConfig(network_bits=2, task_bytes=1000)
    assert partition.splits_for(4, config, r, s) > 3
    want, got = join.equi_join(r, s), join.equi_join(r, s, mode, config).select("key", "s_rid", "r_rid")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_keys_are_dealt_over_slices(spark):
    r, s = sides(spark, [(3, 1), (3, 2), (4, 2), (None, 9)], [(3, 7)] * 400 + [(4, i) for i in range(10)] + [(None, 1)] * 50)
    config = JoinConfig(hot_rows=50, skew_threshold=100)
    assert [tuple(x) for x in skew.hot_keys(s, config).collect()] == [(3, 8)]
    want = join.equi_join(r, s)
    for got in (skew.salted_join(r, s, config), skew.split_join(r, s, config)):
        assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count() == 810


def test_radix_join_adds_no_exchange(spark):
    r, s = sides(spark, [(1, 1)], [(1, 1)])
    for mode in ("radix", "two_level", "modulo"):
        plan = join.equi_join(r, s, mode)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange shufflepartitionidpassthrough") == 2 and "hashpartitioning" not in plan


def test_split_join_keeps_every_row(spark):
    inner = skewed_relation(spark, 300, 50).withColumnRenamed("rid", "r_rid")
    outer = skewed_relation(spark, 4000, 50).withColumnRenamed("rid", "s_rid")
    config = JoinConfig(skew_threshold=200, hot_rows=100)
    assert skew.skew_flags(outer, config).filter("flag > 0").count() > 0
    want = join.equi_join(inner, outer)
    got = skew.split_join(inner, outer, config).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_exchange_keeps_rows_together(spark):
    relation = unique_relation(spark, 3000)
    dealt = partition.radix_exchange(relation).withColumn("at", F.spark_partition_id())
    assert dealt.filter("at <> pid").isEmpty() and dealt.count() == 3000
    two = partition.radix_exchange(relation, levels=2).withColumn("at", F.spark_partition_id()).groupBy("pid", "lpid").agg(F.countDistinct("at").alias("n"))
    assert two.filter("n > 1").isEmpty()


def test_histogram_identities(spark):
    relation = unique_relation(spark, 5000).withColumn("node", F.pmod("rid", F.lit(3)))
    config = JoinConfig(nodes=3)
    local = statistics.local_histogram(relation, F.col("node"), config)
    assert statistics.global_histogram(local, config).agg(F.sum("cnt")).first()[0] == 5000
    assert statistics.window_sizes(local, config).agg(F.sum("size")).first()[0] == 5000
    spans = statistics.absolute_offsets(local, config).join(local, ["node", "pid"]).join(statistics.assignment(local, config).withColumnRenamed("node", "owner"), "pid").collect()
    taken = Counter((x["owner"], x["absolute"] + i) for x in spans for i in range(x["cnt"]))
    assert sum(taken.values()) == 5000 and max(taken.values()) == 1
    assert statistics.sub_histogram(relation).agg(F.sum("cnt")).first()[0] == 5000
