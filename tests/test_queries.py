import math
import os
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera import further_queries, queries


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in queries.SQL:
        assert rows
        return
    found = oracle.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_traversals_span_all(spark, tmp_path):
    n = 6000
    draw = random.Random(3)
    orders = [(k, draw.randrange(n)) for k in range(4 * n)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    edges = [(c, (c * 31 + o * 7) % n) for o, c in orders]
    hop, frontier = {5: 0}, {5}
    while frontier:
        found = {d for s, d in edges if s in frontier} - hop.keys()
        hop |= dict.fromkeys(found, max(hop.values()) + 1)
        frontier = found
    followed = sum(s in hop for s, _ in edges)
    assert len(hop) > 4096
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(run("reachability")) == sorted((k,) for k in hop)
    assert dict(run("hop_counts")) == {h: n for h, n in Counter(hop.values()).items() if h <= 6}
    assert run("traversal_counters") == [(len(hop), followed, followed - len(hop) + 1)]


def test_bloom_membership_keeps_its_rate_for_many_parts(spark, tmp_path):
    n = 300_000
    spark.range(n).select(F.col("id").alias("l_partkey"), F.lit(50.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(2 * n).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    out = entry.queries()["bloom_membership"](spark, str(tmp_path)).where("maybe").groupBy((F.col("p_partkey") < n).alias("bulk")).count().collect()
    found = {r.bulk: r["count"] for r in out}
    assert found[True] == n and found[False] < 0.02 * n


def test_bloom_membership_looks_parts_up_by_word(spark, sf_dir):
    plan = entry.queries()["bloom_membership"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "collect_list" not in plan and "NestedLoop" not in plan


def test_keyed_stream_takes_a_part_in_many_files_as_one_batch(spark, tmp_path, monkeypatch):
    # User 1 has a change in each part and user 2 goes in the last one; the rest is there so that parts fill all files.
    events = [(1, 1, "a"), (2, 2, "b"), (2000, 1, "c"), (5000, 1, "d"), (4998, 2, "gone")] + [(k, 100 + k, "x") for k in range(6000, 6400)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    made = []
    monkeypatch.setattr(further_queries, "folder", lambda _: made.append(f"{tmp_path}/work-{len(made)}") or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.user_id: r.event_type for r in entry.queries()["stream_keyed_changes"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {1: "d"} | {u: "x" for k, u, _ in events[5:] if k % 7}
    parts = [sorted(Path(tmp_path).glob(f"work-*/part={k}/*.parquet")) for k in range(3)]
    assert len(parts[2]) == 4
    assert len(list(Path(tmp_path).glob("work-*/snapshot=*"))) == 3


def test_keyed_stream_of_no_changes(spark, tmp_path):
    spark.createDataFrame([], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert entry.queries()["stream_keyed_changes"](spark, str(tmp_path)).collect() == []


def test_page_floor_takes_all_orders(spark, tmp_path):
    spark.createDataFrame([(601, 1), (703, 2), (704, 3), (790, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in entry.queries()["page_floor"](spark, str(tmp_path)).collect()] == [(703, 2)]


def test_find_probes_all_line_items(spark, sf_dir):
    found = {r.l_orderkey % 3 for r in entry.queries()["lsm_find"](spark, sf_dir).select("l_orderkey").distinct().collect()}
    assert found == {0, 1, 2}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["c_custkey", "c_name", "l_orderkey"]
