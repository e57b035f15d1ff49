import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import registry, scalar as S
from tessera.operators import dataflow, encodings, graph, keyed, ordering, sketches, versioned as V
from tessera.sources import formats
from tessera.streaming.ingest import VersionedFolder, ingest, newest_in_stream, stream_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_running_sum_over_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("p"), (F.col("id") % 5).alias("v"))
    out = {r.p: r.s for r in ordering.running_sum(df, "p", "v", "s", ranges=13).collect()}
    total = 0
    for r in sorted(df.collect()):
        total += r.v
        assert out[r.p] == total
    nexts = {r.p: r.n for r in ordering.shifted(df, "p", "p", "n", ranges=13).collect()}
    assert nexts == {k: k + 1 if k < 999 else None for k in range(1000)}
    before = {r.p: r.n for r in ordering.shifted(df, "p", "p", "n", by=-1, ranges=13).collect()}
    assert before == {k: k - 1 if k else None for k in range(1000)}


@pytest.mark.parametrize(("mode", "want"), [("equal", None), ("gteq", 6), ("lteq", 4), ("greater", 6), ("less", 4), ("next", 6), ("first", 0), ("last", 98)])
def test_ordered_lookup(spark, mode, want):
    found = [r.k for r in keyed.ordered_lookup(spark.range(0, 100, 2).withColumnRenamed("id", "k"), "k", mode, 5).collect()]
    assert found == ([] if want is None else [want])


def test_prefix_is_no_key(spark):
    df = spark.createDataFrame([("/a/b", 1), ("/a/b/c", 2), ("/a/bd", 3)], "k string, v int")
    assert keyed.lookup(df, "k", "/a").count() == 0
    assert keyed.prefix_scan(df, "k", "/a/b").count() == 3 and keyed.prefix_scan(df, "k", "/a", limit=2).count() == 2


def test_upsert_and_iterate(spark):
    table = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    again = table.withColumn("v", F.lit(1))
    assert keyed.upsert_told(table, again, "k").where("replaced").count() == 100
    out = keyed.upsert(table, again, "k")
    assert out.count() == 100 and out.where("v = 1").count() == 100
    assert keyed.same_rows(out, again) and not keyed.same_rows(out, table)


GC = [("a", 2), ("a", 4), ("a", 8), ("b", 2), ("b", 5), ("c", 4), ("c", 12), ("d", 12), ("d", 13), ("d", 16)]


def test_version_gc(spark):
    df = spark.createDataFrame(GC, "g string, epoch long")
    assert rows(V.garbage_collected(df, 10)) == sorted([("a", 8), ("c", 12), ("d", 12), ("d", 13), ("d", 16)], key=str)
    assert ("c", 4) in rows(V.garbage_collected(df, 10, snapshots=True))
    with pytest.raises(ValueError):
        V.advanced(10, 9)


def test_snapshots(spark):
    df = spark.createDataFrame(GC, "g string, epoch long")
    assert rows(V.snapshot(df, ["g"])) == [("a", 8), ("c", 12), ("d", 16)]
    assert rows(V.snapshot(df, ["g"], 4)) == [("a", 4), ("b", 2), ("c", 4)]


def test_merge_equals_any_order(spark):
    parts = [spark.createDataFrame([(k, k % n) for k in range(30)], "k int, v int") for n in (2, 3, 5)]
    assert {tuple(r) for r in V.newest(parts, ["k"]).collect()} == {(k, k % 2) for k in range(30)}
    assert V.count_merged(parts).first().n == len({(k, k % n) for k in range(30) for n in (2, 3, 5)})


def test_retractable_min(spark):
    steps = [(1, 2), (-1, 2), (1, 1), (1, 3), (-1, 1), (1, 1), (1, 2), (-1, 1)]
    df = spark.createDataFrame([(0, k, v, w) for k, (w, v) in enumerate(steps)], "g int, seq int, v long, w int")
    out = [r.min for r in sketches.running_min(df, ["g"], "seq", "v", "w").orderBy("seq").collect()]
    assert out == [2, None, 1, 1, 3, 1, 1, 2]
    assert sketches.retractable_min(df, ["g"], "v", "w").first().min == 2
    assert sketches.multiset_min(df.where("seq < 2"), ["g"], "v", "w").first().min == sketches.NO_MIN


def test_running_min_model(spark):
    draw, data, held = random.Random(4), [], Counter()
    want = []
    for k in range(200):
        v = draw.randrange(12)
        w = -1 if held[v] and draw.random() < 0.5 else 1
        held[v] += w
        data.append((k % 1, k, v, w))
        want.append(min((x for x in held if held[x] > 0), default=None))
    df = spark.createDataFrame(data, "g int, seq int, v long, w int")
    assert [r.min for r in sketches.running_min(df, ["g"], "seq", "v", "w").orderBy("seq").collect()] == want


def test_bloom(spark):
    items = spark.range(10_000).select(F.concat(F.lit("a"), F.md5(F.col("id").cast("string"))).alias("s"))
    others = spark.range(10_000).select(F.concat(F.lit("b"), F.md5(F.col("id").cast("string"))).alias("s"))
    bits, hashes = sketches.bloom_size(10_000, 0.01)
    bloom = sketches.bloom_filter(items, "s", bits, hashes)
    assert sketches.bloom_maybe(items, "s", bloom, bits, hashes).where("not maybe").count() == 0
    assert sketches.bloom_maybe(others, "s", bloom, bits, hashes).where("maybe").count() < 250


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([(10, 100, 1)], [(10, 1, 0), (100, -1, 1)]),
        ([(10, 100, 1), (20, 80, -1)], [(10, 1, 0), (20, -1, 1), (80, 1, 0), (100, -1, 1)]),
        ([(10, 100, 1), (20, 80, -1), (20, 80, 1), (20, 80, 1)], [(10, 1, 0), (20, 1, 1), (80, -1, 2), (100, -1, 1)]),
    ],
)
def test_coverage(spark, ops, want):
    out = encodings.coverage(spark.createDataFrame(ops, "start long, stop long, w int"), weight="w")
    assert sorted(map(tuple, out.collect())) == want


def test_run_lengths(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([5, 5, 5, 5, 7, 5, 5])], "page int, k int, v int")
    assert sorted(map(tuple, encodings.run_lengths(df, ["page"], "k", "v").collect())) == [(0, 0, 0, 4, 5), (0, 1, 4, 1, 7), (0, 2, 5, 2, 5)]
    runs = encodings.run_lengths(df, ["page"], "k", "v", longest=3)
    assert sorted(map(tuple, runs.collect()))[:2] == [(0, 0, 0, 3, 5), (0, 1, 3, 1, 5)]
    assert sorted(map(tuple, encodings.expanded_runs(runs, ["page"]).collect())) == sorted(map(tuple, df.collect()))


def test_graph_ring(spark):
    nodes = graph.ring_graph(spark, 200, 3)
    edges = graph.edges_of(nodes, "id", "neighbors")
    seen = graph.reachable(edges, spark.range(1).withColumnRenamed("id", "node"))
    assert seen.count() == 200 == seen.select("node").distinct().count()
    chain = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.node: r.hop for r in graph.reachable(chain, spark.range(1).withColumnRenamed("id", "node")).collect()} == {k: k for k in range(21)}
    assert graph.hot_set_graph(spark, 100, 3, 10, 1.0).where(F.exists("neighbors", lambda x: x >= 10)).count() == 0


def test_group_collect(spark):
    df = spark.range(10_000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    out = dataflow.group_collect(df, "k", "v")
    assert out.count() == 100 and {r.n for r in out.select(F.size("values").alias("n")).collect()} == {100}
    parts = dataflow.multiplex(df, "k", 7).select("queue", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(parts) == 7 == len({r.queue for r in parts})


def test_hashes(spark):
    import zlib

    r = spark.createDataFrame([("hello",)], "s string").select(S.raw_crc(F.col("s")).alias("crc"), S.fnv1_32(F.col("s").cast("binary")).alias("fnv"), S.little_endian(F.lit(258)).alias("le"), S.log2_floor(F.lit(1023)).alias("lg"), S.power_of_two_below(F.lit(1000)).alias("p2"), S.xor_folded(F.lit(0x12345), 16).alias("xf"), S.partition_of(F.lit("ab"), 5).alias("po"), S.only_of(F.lit("abc-"), "a-c").alias("oo")).first()
    h = 2166136261
    for b in b"hello":
        h = h * 16777619 % 2**32 ^ b
    assert (r.crc, r.fnv, bytes(r.le), r.lg, r.p2) == (zlib.crc32(b"hello") ^ 0xFFFFFFFF, h, (258).to_bytes(8, "little"), 9, 512)
    assert r.xf == 0x1 ^ 0x2345 and r.po == (97 * 31 + 98) % 5 + 1 and r.oo is False


def test_sources(spark, tmp_path):
    ops = formats.generated_ops(spark, 500, seed=3)
    assert ops.where("mode = 'add'").count() == 500 and 0 < ops.where("mode = 'delete'").count() < 25
    assert formats.generated_ops(spark, 500, seed=3).exceptAll(ops).isEmpty()
    ops.write.csv(f"{tmp_path}/ops")
    assert formats.read_op_stream(spark, f"{tmp_path}/ops").exceptAll(ops).isEmpty()
    assert formats.read_op_stream(spark, f"{tmp_path}/ops", ["status", "order"]).columns == ["status", "order"]
    (tmp_path / "kv.tsv").write_text('k1\tv"1\nk2\tv2\n')
    assert rows(formats.read_key_values(spark, str(tmp_path / "kv.tsv"))) == [("k1", 'v"1'), ("k2", "v2")]
    (tmp_path / "n.csv").write_text("1,2,3\n4,5,6\n")
    assert rows(formats.read_int_csv(spark, str(tmp_path / "n.csv"), 3, [2, 0])) == [(3, 1), (6, 4)]
    assert bytes(formats.segment(spark, str(tmp_path / "n.csv"), 2, 3).first().content) == b"2,3"
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    formats.write_tuples(df, f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").first().value == "(1,a)"
    assert rows(formats.decoded(formats.encoded(df), df.schema)) == [(1, "a")]


def test_streamed_table_equals_batch(spark, tmp_path):
    data = spark.createDataFrame([(k % 20, k // 20, 2 * k + (k % 9 == 0)) for k in range(400)], "k long, v long, epoch long")
    data.repartition(5).write.parquet(f"{tmp_path}/in")
    table = VersionedFolder(spark, f"{tmp_path}/table", ["k", "epoch"])
    ingest(stream_folder(spark, f"{tmp_path}/in", data.schema), table, f"{tmp_path}/checkpoint").awaitTermination()
    assert table.components().select("component").distinct().count() > 1
    assert keyed.same_rows(table.rows(), data)
    assert keyed.same_rows(table.read(["k"], 500), V.snapshot(data, ["k"], 500))
    small = table.compact_to(f"{tmp_path}/small", 300)
    assert keyed.same_rows(small.rows(), V.garbage_collected(data, 300))
    table.append(data.limit(3), 0)
    table.append(data.limit(3), 0)
    assert table.components().where("component = 0").count() == 3


def test_streamed_newest(spark, tmp_path):
    data = spark.createDataFrame([(k % 5, 2 * k) for k in range(50)], "k long, epoch long")
    data.write.parquet(f"{tmp_path}/in")
    q = newest_in_stream(stream_folder(spark, f"{tmp_path}/in", data.schema), ["k"]).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("newest")) == [(k, 2 * (45 + k)) for k in range(5)]


def test_paths_positions_and_callbacks(spark, tmp_path):
    tree = spark.createDataFrame([("/", ["/a", "/b"], 0), ("/a", [], 1), ("/b", ["/b/c"], 2), ("/b/c", [], 3)], "k string, children array<string>, v int")
    assert rows(keyed.children_of(tree, "/", "k", "children").select("k", "v")) == [("/a", 1), ("/b", 2)]
    grown = keyed.appended(spark.range(3).select(F.col("id").alias("p"), F.lit(1).alias("v")), "p", F.lit(0), 2)
    assert rows(grown) == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)]
    seen = spark.sparkContext.accumulator(0)
    keyed.for_each_matching(tree, "k", "/b", F.col("v") > 2, lambda r: seen.add(r.v))
    assert seen.value == 3


def test_encoded_component(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    V.write_encoded(df, f"{tmp_path}/c", ["a", "b"], dictionary=["a"], bloom=["b"])
    back = spark.read.parquet(f"{tmp_path}/c")
    assert keyed.same_rows(back, df) and V.component_sizes(back).agg(F.sum("rows")).first()[0] == 1000


def test_group_functions(spark):
    from tessera.functions.registry import register, scalar_function

    df = spark.range(20).select((F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    out = dataflow.group_apply(df, "k", lambda g: g.groupby("k", as_index=False).v.sum(), "k long, v long")
    assert rows(out) == rows(df.groupBy("k").agg(F.sum("v").alias("v")))
    assert dataflow.routed(df, F.col("k"), 3).where("queue > 2").count() == 0
    register(spark)
    assert rows(spark.sql("SELECT * FROM runs(array(5L, 5L, 7L))")) == [(0, 2, 5), (2, 1, 7)]
    assert scalar_function("log2_floor") is S.log2_floor
    with pytest.raises(KeyError):
        scalar_function("nothing")


def test_changes_keep_one_row_a_key(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k long, v string, t int")
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "x", 1), (3, "x", 1), (None, "null", 1), (None, "other", 2)], "k long, v string, t int")
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert got(keyed.upsert(table, changes, "k", "t")) == sorted([(1, "a", 0), (2, "new", 2), (3, "x", 1), (None, "other", 2)], key=str)
    assert got(keyed.upsert(table, changes, "k")) == sorted([(1, "a", 0), (2, "old", 1), (3, "x", 1), (None, "other", 2)], key=str)
    assert got(keyed.insert_absent(table, changes, "k")) == sorted([*map(tuple, table.collect()), (3, "x", 1)], key=str)
    assert got(keyed.delete_keys(table, changes, "k")) == [(1, "a", 0)]


def test_equal_changes_stay_apart_in_running_min(spark):
    changes = spark.createDataFrame([("g", 1, 5, 1), ("g", 1, 5, 1), ("g", 2, 5, -1), ("g", 3, 5, -1), ("g", 4, 7, 1), ("g", 5, 5, 1), ("h", 1, None, 1)], "g string, seq int, v int, w int")
    rows = sorted((r.g, r.seq, r.min) for r in sketches.running_min(changes, ["g"], "seq", "v", "w").collect())
    assert rows == [("g", 1, 5), ("g", 1, 5), ("g", 2, 5), ("g", 3, None), ("g", 4, 7), ("g", 5, 5), ("h", 1, None)]


def test_whole_numbers_stay_exact(spark):
    big = (1 << 60) + 511
    df = spark.createDataFrame([(big,), (-big,), (-1,), (0,), (512,)], "x long")
    x = F.col("x")
    for r in df.select("x", S.floor_div(x, 512).alias("q"), S.rounded_down(x, 512).alias("down"), S.rounded_up(x, 512).alias("up")).collect():
        assert (r.q, r.down, r.up) == (r.x // 512, r.x // 512 * 512, -(-r.x // 512) * 512)


def test_pages_in_order_go_on_to_the_end(spark):
    data = [(None, 1), (1, None), (1, 2), (1, 3), (2, 1), (2, 2), (3, 0)]
    df, after, seen = spark.createDataFrame(data, "a int, b int"), None, []
    while True:
        page = [tuple(r) for r in keyed.page_in_order(df, ["a", "b"], after, 3).collect()]
        seen += page
        if len(page) < 3:
            break
        after = page[-1]
    assert seen == sorted(data, key=lambda r: tuple((x is not None, x) for x in r))


def test_user_functions(spark):
    registry.register_function("plus_seven", lambda c: c + 7)
    assert spark.range(1).select(registry.scalar_function("plus_seven")(F.col("id")).alias("x")).first().x == 7
    for taken in ("plus_seven", "raw_crc"):
        with pytest.raises(KeyError):
            registry.register_function(taken, lambda c: c)


def test_keyed_operations_only_are_routed_by_key(spark):
    df = spark.createDataFrame([("insert", 1), ("scan", 2)], "op string, k long").select(dataflow.by_operation_key("op", ("insert",), "k").alias("q"))
    with pytest.raises(Exception, match="no keyed operation: scan"):
        df.collect()


def test_large_bloom_filters_stay_tables(spark):
    items, probes = spark.range(0, 2000, 2), spark.range(3000).union(spark.createDataFrame([(None,)], "id long"))
    bits, hashes = sketches.bloom_size(1000, 0.01)
    bloom = sketches.bloom_filter(items, "id", bits, hashes)
    sent, joined = (sorted(map(str, sketches.bloom_maybe(probes, "id", bloom, bits, hashes, most_bytes=n).collect())) for n in (1 << 20, 0))
    assert sent == joined and len(sent) == 3001


def test_bloom_lookups_carry_no_whole_filter(spark):
    items = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    probes = spark.createDataFrame([("a", 1), ("a", 1), ("zz", 2), (None, 3), (None, 3)], "s string, n int")
    bits, hashes = sketches.bloom_size(1000, 0.01)
    bloom = sketches.bloom_filter(items, "s", bits, hashes)
    for most_bytes in (1 << 20, 0):
        out = sketches.bloom_maybe(probes, "s", bloom, bits, hashes, most_bytes=most_bytes)
        assert out.columns == ["s", "n", "maybe"]
        assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, True), ("a", 1, True), ("zz", 2, False), (None, 3, False), (None, 3, False)], key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        assert ("BroadcastHashJoin" in plan and "LeftAnti, BuildRight" in plan) or most_bytes == 0


def test_bloom_items_are_hashed_once_for_all_positions(spark):
    items = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    probes = spark.createDataFrame([("a",), ("zz",), ("no hash",), (None,)], "s string")
    bits, hashes = sketches.bloom_size(1000, 0.01)
    bloom = sketches.bloom_filter(items, "s", bits, hashes, sketches.by_md5)
    of = lambda s: [int(hashlib.md5(s.encode()).hexdigest()[k : k + 8], 16) % bits for k in (0, 8)]
    places = {(a + k * b) % bits for a, b in map(of, "ab") for k in range(hashes)}
    assert {32 * r.word + k for r in bloom.collect() if r.word is not None for k in range(32) if r["mask"] >> k & 1} == places
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan(bloom) and plan(bloom).count("md5(") == 2
    for most_bytes in (1 << 20, 0):
        out = sketches.bloom_maybe(probes, "s", spark.createDataFrame(bloom.collect(), bloom.schema), bits, hashes, sketches.by_md5, most_bytes)
        assert plan(out).count("md5(") == 4  # a pair to look up, and a pair for what was found
        none = lambda c: tuple(F.when(c != "no hash", h) for h in sketches.by_md5(c))
        found = [dict(map(tuple, sketches.bloom_maybe(probes, "s", bloom, bits, hashes, pair, most_bytes).collect())) for pair in (sketches.by_md5, none)]
        assert found == [{"a": True, "zz": False, "no hash": False, None: False}] * 2


def test_components_merge_when_due(spark, tmp_path):
    from tessera.streaming.ingest import VersionedFolder

    folder = VersionedFolder(spark, str(tmp_path / "t"), ["k", "epoch"])
    row = lambda lo, hi, epoch: spark.range(lo, hi).selectExpr("id as k", f"{epoch}L as epoch")
    folder.append(row(0, 20_000, 2), 0)
    assert not folder.due()
    folder.append(row(0, 10, 3), 1)
    assert not folder.maintain(4)
    for n in range(2, 8):
        folder.append(row(2500 * n, 2500 * (n + 1), 2 * n), n)
    before = sorted(map(tuple, folder.read(["k"]).collect()))
    assert folder.maintain(4) and len(folder.sizes()) == 1
    assert sorted(map(tuple, folder.read(["k"]).collect())) == before
    folder.append(row(0, 5, 90), 8)
    assert folder.read(["k"]).where("epoch = 90").count() == 5
    folder.append(row(0, 20_000, 100), 9)
    with pytest.raises(ValueError):
        folder.maintain(2)
