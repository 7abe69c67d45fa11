"""Every query of the join engine over the tables of a folder, and its SQL.

``orders`` by order key is the inner (build) relation and ``lineitem`` the outer
(probe) one unless a query says otherwise; ``l_suppkey % 4`` stands for the node
that holds a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.codec import compress, decompress
from ..operators import join, partition, skew, statistics
from ..sources.relations import as_relation, distributed, load, modulo_relation, node_of, power_law_relation, shuffled, unique_relation
from .metrics import counters, report, store, stored, timed_phases, timed_run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns that order the items of one order without ties but for equal rows.
ITEM_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def inner(spark: SparkSession, sf: str) -> DataFrame:
    return as_relation(load(spark, sf, "orders"), "o_orderkey", "o_custkey")


def outer(spark: SparkSession, sf: str) -> DataFrame:
    return as_relation(load(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def inner_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return as_relation(load(spark, sf, "orders"), "o_orderkey", "o_custkey").withColumnRenamed("rid", "r_rid")


def outer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return as_relation(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey").withColumnRenamed("rid", "s_rid")


def node() -> Column:
    return node_of(F.col("rid"), DEFAULT.nodes)


PAIRS = "select o_orderkey as key, o_custkey as r_rid, l_partkey as s_rid from orders join lineitem on o_orderkey = l_orderkey"
PIDS = "(select range as pid from range(32))"
BY_PID = f"select p.pid, cast(count(l_orderkey) as bigint) as matches from {PIDS} p left join (select l_orderkey from orders join lineitem on o_orderkey = l_orderkey) on l_orderkey & 31 = p.pid group by p.pid"


@query("select count(*) as matches from orders join lineitem on o_orderkey = l_orderkey")
def join_match_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.match_count(inner(spark, sf), outer(spark, sf))


@query(BY_PID)
def join_radix_partition_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.partition_match_count(inner(spark, sf), outer(spark, sf))


@query("select o_orderkey & 31 as pid, (o_orderkey >> 5) & 31 as lpid, count(*) as matches from orders join lineitem on o_orderkey = l_orderkey group by 1, 2")
def join_two_level_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.two_level_match_count(inner(spark, sf), outer(spark, sf))


@query(PAIRS)
def join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return join.equi_join(inner_pairs(spark, sf), outer_pairs(spark, sf))


@query(PAIRS)
def join_pairs_radix(spark: SparkSession, sf: str) -> DataFrame:
    return join.equi_join(inner_pairs(spark, sf), outer_pairs(spark, sf), "radix")


@query(PAIRS)
def join_pairs_two_level(spark: SparkSession, sf: str) -> DataFrame:
    return join.equi_join(inner_pairs(spark, sf), outer_pairs(spark, sf), "two_level")


@query(f"select key % 64 as pid, key, r_rid, s_rid from ({PAIRS})")
def join_global_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = join.equi_join(inner_pairs(spark, sf), outer_pairs(spark, sf), "modulo")
    return pairs.select(statistics.mod_l1(F.col("key"), join.REMAINDERS).alias("pid"), "key", "r_rid", "s_rid")


@query("select p_partkey as key, cast(p_size as bigint) as r_rid, l_orderkey as s_rid from part join lineitem on p_partkey = l_partkey")
def join_broadcast_pairs(spark: SparkSession, sf: str) -> DataFrame:
    parts = as_relation(load(spark, sf, "part"), "p_partkey", "p_size").withColumnRenamed("rid", "r_rid")
    items = as_relation(load(spark, sf, "lineitem"), "l_partkey", "l_orderkey").withColumnRenamed("rid", "s_rid")
    return join.equi_join(parts, items, "broadcast")


@query("select cast(sum(c * c) as bigint) as matches from (select count(*) as c from lineitem group by l_suppkey)")
def join_many_to_many_count(spark: SparkSession, sf: str) -> DataFrame:
    items = as_relation(load(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")
    return join.match_count(items, items)


@query("select count(*) as matches from orders join lineitem on o_orderkey = l_orderkey")
def join_packed_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.packed_match_count(inner(spark, sf), outer(spark, sf))


@query("select o_orderkey as key, o_custkey as r_rid, min(l_partkey) as s_rid from orders join lineitem on o_orderkey = l_orderkey group by 1, 2")
def join_one_match(spark: SparkSession, sf: str) -> DataFrame:
    return join.first_match(outer_pairs(spark, sf), inner_pairs(spark, sf), "s_rid")


@query("select l_orderkey as s_rid, p_partkey as key, min(cast(p_size as bigint)) as r_rid from part join lineitem on p_partkey = l_partkey group by l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice, p_partkey")
def join_broadcast_one_match(spark: SparkSession, sf: str) -> DataFrame:
    """No partitions: every item probes one copied table and takes at most one match."""
    parts = as_relation(load(spark, sf, "part"), "p_partkey", "p_size").withColumnRenamed("rid", "r_rid")
    items = as_relation(load(spark, sf, "lineitem"), "l_partkey", "l_orderkey").withColumnRenamed("rid", "s_rid")
    return join.first_match(parts, items, "r_rid", "broadcast")


@query(
    """with r as (select o_orderkey as k, o_custkey as v from orders union all select o_orderkey + 137438953472, o_custkey + 4294967296 from orders),
    s as (select l_orderkey as k from lineitem union all select l_orderkey + 274877906944 from lineitem union all select l_orderkey + 137438953472 from lineitem where l_linenumber = 1)
    select count(*) as matches from r join s on r.k = s.k"""
)
def join_packed_count_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that differ only above the 37 bits that packing keeps, and row ids above its 32."""
    r = inner(spark, sf)
    wide = r.select((F.col("key") + (1 << 37)).alias("key"), (F.col("rid") + (1 << 32)).alias("rid"))
    s = outer(spark, sf)
    first = as_relation(load(spark, sf, "lineitem").filter("l_linenumber = 1"), "l_orderkey", "l_suppkey")
    beyond = s.select((F.col("key") + (1 << 38)).alias("key"), "rid").unionAll(first.select((F.col("key") + (1 << 37)).alias("key"), "rid"))
    return join.packed_match_count(r.unionAll(wide), s.unionAll(beyond))


@query(
    f"""select key, r_rid, l_partkey, l_suppkey, l_linenumber from (
        select o_orderkey as key, o_custkey as r_rid, l.*, row_number() over (partition by o_orderkey order by {", ".join(ITEM_ORDER)}) as place
        from orders join lineitem l on o_orderkey = l_orderkey) where place <= 8"""
)
def join_capped_matches(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), *ITEM_ORDER)
    return join.capped_matches(items, inner_pairs(spark, sf), ITEM_ORDER, DEFAULT.max_matches).select("key", "r_rid", "l_partkey", "l_suppkey", "l_linenumber")


@query("select l_suppkey % 4 as node, l_orderkey & 31 as pid, count(*) as cnt from lineitem group by 1, 2")
def hist_local(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.local_histogram(outer(spark, sf), node())


@query("select o_orderkey & 31 as pid, count(*) as cnt from orders group by 1")
def hist_global_inner(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.global_histogram(statistics.local_histogram(inner(spark, sf), node()))


@query("select l_orderkey & 31 as pid, count(*) as cnt from lineitem group by 1")
def hist_global_outer(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.global_histogram(statistics.local_histogram(outer(spark, sf), node()))


@query("select range as pid, range % 4 as node from range(32)")
def partition_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.assignment(spark.range(0))


LOCAL = """local as (select n.range as node, p.range as pid, cast(count(l_orderkey) as bigint) as cnt
    from range(4) n cross join range(32) p left join {0} on {1} % 4 = n.range and {2} & 31 = p.range group by 1, 2),
  global as (select pid, cast(sum(cnt) as bigint) as cnt, pid % 4 as node from local group by pid),
  base as (select pid, node, coalesce(cast(sum(cnt) over (partition by node order by pid rows between unbounded preceding and 1 preceding) as bigint), 0) as base from global),
  relative as (select node, pid, coalesce(cast(sum(cnt) over (partition by pid order by node rows between unbounded preceding and 1 preceding) as bigint), 0) as relative from local),
  absolute as (select r.node, r.pid, relative + base as absolute from relative r join base b on r.pid = b.pid)"""
OUTER = LOCAL.format("lineitem", "l_suppkey", "l_orderkey")
INNER = LOCAL.format("orders", "o_custkey", "o_orderkey").replace("count(l_orderkey)", "count(o_orderkey)")


def outer_local(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.local_histogram(outer(spark, sf), node())


@query(f"with {OUTER} select pid, node, base from base")
def offset_base(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.base_offsets(outer_local(spark, sf))


@query(f"with {OUTER} select node, pid, relative from relative")
def offset_relative(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.relative_offsets(outer_local(spark, sf))


@query(f"with {OUTER} select node, pid, absolute from absolute")
def offset_absolute(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.absolute_offsets(outer_local(spark, sf))


@query("select (l_orderkey & 31) % 4 as node, count(*) as size from lineitem group by 1")
def window_size(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.window_sizes(outer_local(spark, sf))


@query(
    f"""with i as (with {INNER} select a.node, a.pid, a.absolute as inner_offset, g.cnt as inner_count from absolute a join global g on a.pid = g.pid),
    o as (with {OUTER} select a.node, a.pid, a.absolute as outer_offset, g.cnt as outer_count from absolute a join global g on a.pid = g.pid)
    select i.node, i.pid, i.inner_offset, i.inner_count, o.outer_offset, o.outer_count, i.pid % 4 as owner from i join o on i.node = o.node and i.pid = o.pid"""
)
def histogram_computation(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.histogram_computation(inner(spark, sf), outer(spark, sf), node())


@query("select l_orderkey & 31 as pid, count(*) as declared, count(*) as written from lineitem group by 1")
def exchange_conservation(spark: SparkSession, sf: str) -> DataFrame:
    return partition.conserved(outer(spark, sf))


@query("select l_orderkey % 16 as p1, l_orderkey // 16 % 16 as p2, count(*) as declared, count(*) as written from lineitem group by 1, 2")
def exchange_modulo(spark: SparkSession, sf: str) -> DataFrame:
    return partition.modulo_conserved(outer(spark, sf), 16, 16)


@query("select l_orderkey % 64 as p1, cast(0 as bigint) as p2, count(*) as declared, count(*) as written from lineitem group by 1")
def exchange_modulo_global(spark: SparkSession, sf: str) -> DataFrame:
    return partition.modulo_conserved(outer(spark, sf), 64, 1)


@query("select l_orderkey & 31 as pid, (l_orderkey >> 5) & 31 as lpid, count(*) as cnt from lineitem group by 1, 2")
def hist_sublevel(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.sub_histogram(outer(spark, sf))


@query(
    """with c as (select p.range as pid, l.range as lpid, count(l_orderkey) as cnt from range(32) p cross join range(32) l
        left join lineitem on l_orderkey & 31 = p.range and (l_orderkey >> 5) & 31 = l.range group by 1, 2)
    select pid, lpid, coalesce(cast(sum((cnt + 7) // 8 * 8) over (partition by pid order by lpid rows between unbounded preceding and 1 preceding) as bigint), 0) as "offset" from c"""
)
def offset_padded(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.padded_offsets(outer(spark, sf))


@query(
    """with r as (select o_orderkey & 31 as pid, (o_orderkey >> 5) & 31 as lpid, count(*) as r_count from orders group by 1, 2),
    s as (select l_orderkey & 31 as pid, (l_orderkey >> 5) & 31 as lpid, count(*) as s_count from lineitem group by 1, 2)
    select r.pid, r.lpid, r_count, s_count from r join s on r.pid = s.pid and r.lpid = s.lpid"""
)
def subpartition_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.sub_partition_tasks(inner(spark, sf), outer(spark, sf))


@query("select l_orderkey % 16 as p1, count(*) as cnt from lineitem group by 1")
def mod_hist_l1(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.modulo_histogram(outer(spark, sf), 16)


@query("select l_orderkey % 16 as p1, l_orderkey // 16 % 16 as p2, count(*) as cnt from lineitem group by 1, 2")
def mod_hist_l2(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.modulo_histogram_l2(outer(spark, sf), 16, 16)


@query("select l_orderkey % 64 as p1, count(*) as cnt from lineitem group by 1")
def mod_hist_global(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.modulo_histogram(outer(spark, sf), 64)


@query("select p1, count(*) as tiles, cast(sum(c) as bigint) as cnt from (select l_linenumber as tile, l_orderkey % 16 as p1, count(*) as c from lineitem group by 1, 2) group by p1")
def mod_hist_tiled(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    return statistics.tiled_histogram(items, 16, F.col("l_linenumber"))


def tiled(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("tile"))


@query("select p1, p2, count(*) as tiles, cast(sum(c) as bigint) as cnt from (select l_linenumber as tile, l_orderkey % 16 as p1, l_orderkey // 16 % 16 as p2, count(*) as c from lineitem group by 1, 2, 3) group by p1, p2")
def mod_hist_tiled_l2(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.tiled_histogram_l2(tiled(spark, sf), 16, 16, F.col("tile"))


@query("select p1, count(*) as tiles, cast(sum(c) as bigint) as cnt from (select l_linenumber as tile, l_orderkey % 64 as p1, count(*) as c from lineitem group by 1, 2) group by p1")
def mod_hist_tiled_global(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.tiled_histogram(tiled(spark, sf), 64, F.col("tile"))


@query(
    """with t as (select l_linenumber as tile, l_orderkey % 16 as p1, l_orderkey // 16 % 16 as p2, count(*) as cnt from lineitem group by 1, 2, 3)
    select tile, p1, p2, cnt, coalesce(cast(sum(cnt) over (order by p1, p2, tile rows between unbounded preceding and 1 preceding) as bigint), 0) as base from t"""
)
def tiled_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.tiled_offsets(tiled(spark, sf), 16, 16, F.col("tile"))


@query(
    """with c as (select p.range as pid, count(l_orderkey) as cnt from range(64) p left join lineitem on l_orderkey % 64 = p.range group by 1),
    s as (select pid, cnt, coalesce(cast(sum(cnt) over (order by pid rows between unbounded preceding and 1 preceding) as bigint), 0) as start from c)
    select pid, start, start + cnt as "end" from s"""
)
def partition_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.partition_ranges(outer(spark, sf), 64)


@query(
    """with n as (select o_orderkey & 31 as pid, count(*) as build_rows from orders group by 1),
    b as (select pid, build_rows, case when build_rows <= 1 then 1 else cast(pow(2, length(bin(build_rows - 1))) as bigint) end as buckets from n),
    c as (select b.pid, (o_orderkey >> 10) & (buckets - 1) as bucket, count(*) as chain from orders join b on o_orderkey & 31 = b.pid group by 1, 2),
    s as (select b.pid, (l_orderkey >> 10) & (buckets - 1) as bucket, count(*) as probes from lineitem join b on l_orderkey & 31 = b.pid group by 1, 2)
    select c.pid, any_value(build_rows) as build_rows, any_value(buckets) as buckets, count(*) as used_buckets, max(chain) as longest_chain,
           cast(sum(chain * coalesce(probes, 0)) as bigint) as comparisons
    from c join b on c.pid = b.pid left join s on c.pid = s.pid and c.bucket = s.bucket group by c.pid"""
)
def hash_bucket_stats(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.chain_statistics(inner(spark, sf), outer(spark, sf))


@query("select o_orderkey % 16 as bucket, count(*) as cnt from orders group by 1")
def bucket_table(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.bucket_table(inner(spark, sf), DEFAULT.buckets)


@query("select l_orderkey & 31 as pid, l_suppkey + ((l_orderkey >> 5) << 32) as value from lineitem")
def compress_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return compress(outer(spark, sf))


@query("select l_orderkey as key, l_suppkey as rid from lineitem")
def decompress_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return decompress(compress(outer(spark, sf)))


COUNTED = f"(select p.pid, count(l_orderkey) as cnt from {PIDS} p left join lineitem on l_orderkey & 31 = p.pid group by p.pid)"


@query(f"select pid, cnt // 500 + 1 as blocks from {COUNTED}")
def skew_detect(spark: SparkSession, sf: str) -> DataFrame:
    return skew.skew_blocks(outer(spark, sf))


@query(f"select pid, cnt // 500 as flag from {COUNTED}")
def skew_flags(spark: SparkSession, sf: str) -> DataFrame:
    return skew.skew_flags(outer(spark, sf))


@query(
    f"""with b as (select pid, cnt // 500 + 1 as blocks from {COUNTED}),
    f as (select pid, blocks, coalesce(cast(sum(blocks) over (order by pid rows between unbounded preceding and 1 preceding) as bigint), 0) as first from b),
    o as (select pid, first, unnest(generate_series(0, blocks - 1)) as ordinal from f)
    select first + ordinal as block, pid, ordinal from o"""
)
def skew_block_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return skew.block_mapping(outer(spark, sf))


@query(BY_PID)
def join_skew_salted(spark: SparkSession, sf: str) -> DataFrame:
    outer_rows = outer(spark, sf).withColumnRenamed("rid", "s_rid")
    joined = skew.salted_join(inner(spark, sf).select("key"), outer_rows)
    counts = joined.groupBy(F.col("key").bitwiseAND(31).alias("pid")).agg(F.count(F.lit(1)).alias("cnt"))
    return statistics.dense(counts, statistics.numbers(joined, 32, "pid")).withColumnRenamed("cnt", "matches")


@query(PAIRS)
def join_skew_split(spark: SparkSession, sf: str) -> DataFrame:
    return skew.split_join(inner_pairs(spark, sf), outer_pairs(spark, sf)).select("key", "r_rid", "s_rid")


@query("select range as key, cast(1 as bigint) as n from range(10000)")
def gen_unique(spark: SparkSession, sf: str) -> DataFrame:
    return unique_relation(spark, 10_000).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("select range % 1000 as key, range as rid from range(10000)")
def gen_modulo(spark: SparkSession, sf: str) -> DataFrame:
    return modulo_relation(spark, 10_000, 1000)


@query("select range % 1000 as key, range as rid from range(10000)")
def gen_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled(modulo_relation(spark, 10_000, 1000))


POWER_LAW = "(select 1000 // (range % 1000 + 1) + case when range % 100 < 60 then 0 else 1000 end as key, range as rid from range(10000))"


@query(f"select key, rid from {POWER_LAW}")
def gen_power_law(spark: SparkSession, sf: str) -> DataFrame:
    return power_law_relation(spark, 10_000, 1000, 60)


@query(f"select count(*) as matches from {POWER_LAW} s join range(1, 1001) r on s.key = r.range")
def gen_power_law_join_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.match_count(unique_relation(spark, 1000, 1), power_law_relation(spark, 10_000, 1000, 60))


@query("select cast(4 as bigint) as nodes, cast(10000 as bigint) as n, cast(sum(range) as bigint) as total from range(10000)")
def gen_distributed(spark: SparkSession, sf: str) -> DataFrame:
    placed = distributed(unique_relation(spark, 10_000), DEFAULT.nodes).withColumn("node", F.spark_partition_id())
    return placed.agg(F.countDistinct("node").alias("nodes"), F.count(F.lit(1)).alias("n"), F.sum("rid").alias("total"))


@query("select cast(10000 as bigint) as matches")
def gen_join_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.match_count(unique_relation(spark, 10_000), unique_relation(spark, 10_000, start_rid=10_000))


@query("select cast(10000 as bigint) as matches")
def gen_modulo_join_count(spark: SparkSession, sf: str) -> DataFrame:
    return join.match_count(unique_relation(spark, 1000), modulo_relation(spark, 10_000, 1000))


@query("select l_orderkey as key, l_suppkey as rid, l_orderkey % 1000 as shown from lineitem")
def debug_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of a relation, as a look into it prints them; ``shown`` is the key by the modulus of the display."""
    return outer(spark, sf).withColumn("shown", F.col("key") % 1000)


@query("select c_custkey as key, c_acctbal as value from customer where c_acctbal < 0")
def debug_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """The negative entries of a buffer; to show only them is what that display is for."""
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")).filter("value < 0")


COUNTERS = """
    with r as (select o_orderkey & 31 as pid, (o_orderkey >> 5) & 31 as lpid, count(*) as n from orders group by 1, 2),
    s as (select l_orderkey & 31 as pid, (l_orderkey >> 5) & 31 as lpid, count(*) as n from lineitem group by 1, 2),
    c as (select (select count(*) from orders) as r, (select count(*) from lineitem) as s,
        (select count(*) from r join s on r.pid = s.pid and r.lpid = s.lpid) as shared, (select count(*) from orders join lineitem on o_orderkey = l_orderkey) as m)
    select unnest(['HILOCELEM', 'HOLOCELEM', 'LPTASKCOUNT', 'LPELEMENTS', 'BPTASKCOUNT', 'BPBUILDELEM', 'BPPROBEELEM', 'RESULTS']) as name,
           unnest([r, s, 32, r + s, shared, r, s, m]) as value,
           unnest(['tuples', 'tuples', 'tasks', 'tuples', 'tasks', 'tuples', 'tuples', 'tuples']) as unit from c"""


@query(COUNTERS)
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return counters(inner(spark, sf), outer(spark, sf))


@query(f"select 0 as run, name, value, unit from ({COUNTERS})")
def metrics_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The counters written as files of a run and read back."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/metrics-{uuid.uuid4().hex}"
    store(run_counters(spark, sf).withColumn("run", F.lit(0)), path)
    return stored(spark, path)


@query()
def run_phases(spark: SparkSession, sf: str) -> DataFrame:
    return report(timed_phases(inner(spark, sf), outer(spark, sf)).frame(spark))


@query()
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return report(timed_run(inner(spark, sf), outer(spark, sf)).frame(spark))
