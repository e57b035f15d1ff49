"""Queries that run what writes and streams, and the operators that have no other query; registered beside those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .functions import registry, scalar as S
from .operators import dataflow, encodings, graph, keyed, maps, ordering, sketches, versioned as V
from .queries import CUSTOMER_EDGES, OPS, PAGES, components, customer_edges, customers, ops, query, source, table, versions
from .queries import COMPONENTS, VERSIONS
from .sources import formats
from .sources.catalog import Engine
from .streaming import ingest as I


def folder(spark) -> str:
    """A new folder that all executors see."""
    return f"{graph.shared_folder(spark)}/work-{uuid.uuid4().hex}"


# Scripts -------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('ann', 41), ('cid', -3)) t(_0, _1)")
def script_create(spark, sf_dir):
    engine = Engine(spark)
    engine.run('create people (string,int) insert people ("ann",40) insert people ("bob",7) insert people ("ann",41) insert people (cid,-3) delete people ("bob")')
    return engine.query("people")


@query("SELECT * FROM (VALUES ('a', 0, 5, NULL), ('b', 1, NULL, 'five')) t(_0_string, variant, _1_int, _1_string)")
def script_union_types(spark, sf_dir):
    """Rows of one table in two shapes."""
    engine = Engine(spark)
    engine.run('create things (string,int)|(string,string) insert things ("a",5) insert things ("b","five")')
    return engine.query("things")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey <> 3")
def script_abort(spark, sf_dir):
    """What is committed stays; what is told after that and aborted never was."""
    engine = Engine(spark, {"customer": customers(spark, sf_dir)}, autocommit=False)
    engine.run("delete customer (3)")
    engine.commit()
    engine.run('insert customer (-9,"gone",1) delete customer (4)')
    engine.abort()
    return engine.query("customer")


@query("SELECT * FROM (VALUES ('with \"quotes\", and commas', 1), ('plain', 2)) t(_0, _1)")
def program_changes(spark, sf_dir):
    """Rows told by a program."""
    engine = Engine(spark)
    engine.run("create t (string,int)")
    engine.insert("t", 'with "quotes", and commas', 1)
    engine.insert("t", "gone", 0)
    engine.insert("t", "plain", 2)
    engine.delete("t", "gone")
    return engine.query("t")


# Ordered reads, positions, lists ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY l_orderkey, l_linenumber LIMIT 50")
def ordered_page(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return keyed.page_in_order(rows, ["l_orderkey", "l_linenumber"], (100, 3), 50)


@query(f"WITH {COMPONENTS} SELECT DISTINCT l_orderkey, l_linenumber, quantity FROM c WHERE (l_orderkey, l_linenumber, quantity) > (500, 3, 10) ORDER BY l_orderkey, l_linenumber, quantity LIMIT 40")
def lsm_page(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "quantity"]
    return keyed.page_in_order(V.merged(components(spark, sf_dir)), order, (500, 3, 10), 40)


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def sorted_workload(spark, sf_dir):
    """All orders by date, with their place: numbered along ranges, not in one task."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    at = rows.withColumn("_at", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * (1 << 40) + F.col("o_orderkey")).withColumn("_one", F.lit(1))
    return ordering.running_sum(at, "_at", "_one", "place").select("o_orderkey", "o_orderdate", "place")


@query("SELECT DISTINCT o_custkey FROM orders")
def sorted_keys(spark, sf_dir):
    return keyed.sorted_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def sorted_set_scan(spark, sf_dir):
    """One user's events, in order of time."""
    rows = table(spark, sf_dir, "events")
    first = rows.agg(F.min("user_id").alias("_u"))
    return keyed.in_order(rows.join(F.broadcast(first), F.col("user_id") == F.col("_u")).select("event_id", "ts", "event_type"), ["ts", "event_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 100)")
def comparator_lookup(spark, sf_dir):
    """The next key behind 100 where the order of keys is turned round."""
    return keyed.ordered_lookup(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey", "next", 100, lambda k: -k)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey % 100, c_custkey LIMIT 25")
def comparator_order(spark, sf_dir):
    """The first rows where keys sort by their last two digits, then as a whole."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return keyed.in_order(rows, ["c_custkey"], lambda k: F.struct(F.pmod(k, F.lit(100)), k)).limit(25)


@query("SELECT max(o_orderkey) + 1 AS length FROM orders")
def positional_length(spark, sf_dir):
    return keyed.positional_length(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + 1 + i, -1 FROM range(5) t(i)")
def positional_append(spark, sf_dir):
    return keyed.appended(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), "n_nationkey", F.lit(-1).cast("long"), 5)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def positional_truncate(spark, sf_dir):
    return keyed.truncated(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), "n_nationkey", 10)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def list_remove_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "user_id", "event_id")
    return keyed.remove_first(rows, rows.select("user_id"), "user_id", "event_id")


@query("SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (2, 'two')) t(number, word)")
def literal_rows(spark, sf_dir):
    return keyed.literal_rows(spark, [(1, "one"), (2, "two"), (2, "two")], "number int, word string")


@query("SELECT c_acctbal, c_mktsegment FROM customer")
def tuple_tail(spark, sf_dir):
    return keyed.tail_columns(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), 2)


@query("SELECT true AS same, false AS other")
def same_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    doubled = orders.unionAll(orders)
    return spark.createDataFrame([(keyed.same_rows(orders.repartition(3), orders), keyed.same_rows(orders, doubled))], "same boolean, other boolean")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def children_of(spark, sf_dir):
    """A region lists its nations; their own entries."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("path"), "n_nationkey", "n_name", F.array().cast("array<string>").alias("children"))
    listed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.concat(F.lit("n"), "n_nationkey")).alias("children"))
    regions = listed.select(F.concat(F.lit("r"), "n_regionkey").alias("path"), F.lit(None).cast("long").alias("n_nationkey"), F.lit(None).cast("string").alias("n_name"), "children")
    return keyed.children_of(nations.unionByName(regions), "r2", "path", "children").select("n_nationkey", "n_name")


# Maps ------------------------------------------------------------------------------------------------------


USER_MAPS = "e AS (SELECT user_id, event_type, max(event_id) AS v FROM events GROUP BY ALL)"


def user_maps(spark, sf_dir):
    return maps.collected(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(f"WITH {USER_MAPS} SELECT user_id, list(event_type ORDER BY event_type) AS keys, min(event_type) AS first, min(CASE WHEN event_type > 'click' THEN event_type END) AS after_click FROM e GROUP BY user_id")
def map_keys(spark, sf_dir):
    found = maps.keys_in_order(user_maps(spark, sf_dir))
    first = maps.key_after(found, None).withColumnRenamed("next", "first")
    return maps.key_after(first, "click").withColumnRenamed("next", "after_click").drop("m")


@query(f"WITH {USER_MAPS}, n AS (SELECT * FROM e WHERE NOT (user_id % 2 = 0 AND event_type IN ('new', 'click')) UNION ALL SELECT user_id, 'new', user_id FROM e WHERE user_id % 2 = 0 GROUP BY user_id UNION ALL SELECT user_id, 'click', -1 FROM e WHERE user_id % 2 = 0 GROUP BY user_id) SELECT user_id, event_type, v FROM n WHERE event_type <> 'view'")
def map_update(spark, sf_dir):
    """Every other user gets two names, one of which may be there; one name is dropped from all."""
    old = user_maps(spark, sf_dir)
    new = old.where("user_id % 2 = 0").select("user_id", F.create_map(F.lit("new"), F.col("user_id").cast("long"), F.lit("click"), F.lit(-1).cast("long")).alias("m"))
    return maps.dropped(maps.stored(old, new, "user_id"), ["view"]).select("user_id", F.explode("m").alias("event_type", "v"))


# Files and components ----------------------------------------------------------------------------------------


@query(f"WITH {OPS} SELECT mode, xid AS \"order\", cust AS custkey FROM ops")
def op_stream_file(spark, sf_dir):
    """Operations written as a file without header, and read back with columns picked."""
    path = folder(spark)
    named = [f.split()[0] for f in formats.OP_COLUMNS.split(", ")]
    known = {"mode": F.col("mode"), "order": F.col("xid"), "totalprice": F.col("cust")}
    ops(spark, sf_dir).select(*[known.get(c, F.lit(1)).alias(c) for c in named]).write.csv(path)
    return formats.read_op_stream(spark, path, ["mode", "order", "totalprice"]).withColumnRenamed("totalprice", "custkey")


@query("SELECT o_custkey AS c0, o_orderkey AS c1 FROM orders")
def int_file(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0), "o_custkey").write.csv(path)
    return formats.read_int_csv(spark, path, 3, [2, 0])


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer")
def key_value_file(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").write.csv(path, sep="\t")
    return formats.read_key_values(spark, path)


@query("SELECT 'PAR1' AS head")
def file_segment(spark, sf_dir):
    found = formats.segment(spark, f"{sf_dir}/nation.parquet", 0, 4)
    return found.select(F.decode("content", "UTF-8").alias("head")).limit(1)


@query("SELECT * FROM supplier")
def encoded_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return formats.decoded(formats.encoded(rows), rows.schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def component_file(spark, sf_dir):
    """A component in key order; a range of keys reads the row groups that hold it."""
    path = folder(spark)
    V.write_component(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderkey"])
    return spark.read.parquet(path).where("o_orderkey between 100 and 200")


@query("SELECT count(*) AS rows, true AS smaller FROM orders")
def encoded_component(spark, sf_dir):
    """Encodings by column, dictionary or delta; and what they save against text."""
    path = folder(spark)
    V.write_encoded(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderkey"], ["o_orderstatus"])
    return V.compression(spark, path).select("rows", (F.col("ratio") > 1).alias("smaller"))


@query("SELECT count(*) AS rows FROM orders")
def component_sizes(spark, sf_dir):
    path = folder(spark)
    V.write_component(table(spark, sf_dir, "orders", "o_orderkey"), path, ["o_orderkey"])
    return V.component_sizes(spark.read.parquet(path)).agg(F.sum("rows").alias("rows"))


@query("SELECT event_id, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS entry FROM events WHERE event_id > 20 ORDER BY event_id LIMIT 30")
def log_dump(spark, sf_dir):
    return V.log_dump(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "event_id", 30, 20)


@query("SELECT i AS c0, i // 65536 AS c1, i // 12514500 AS c2, i // 10000000 AS c3, i // 65536 AS c4 FROM range(0, 40000000, 77777) t(i)")
def synthetic_columns(spark, sf_dir):
    return spark.range(0, 40_000_000, 77_777).select(*S.synthetic_columns(F.col("id"))[:5])


# Streams -----------------------------------------------------------------------------------------------------


def event_files(spark, sf_dir, files: int = 6):
    """Events as a folder of files, and a stream of them, one file a batch."""
    path = folder(spark)
    rows = versions(spark, sf_dir)
    rows.repartition(files, F.col("epoch")).write.parquet(path)
    return I.stream_folder(spark, path, rows.schema)


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch DESC) = 1 AND epoch % 2 = 0")
def stream_ingest(spark, sf_dir):
    """A stream into a versioned folder, a component a batch, merged as it grows; then read."""
    target = I.VersionedFolder(spark, folder(spark), ["user_id", "event_type", "epoch"])
    I.ingest(event_files(spark, sf_dir), target, folder(spark), horizon=0).awaitTermination()
    return target.read(["user_id", "event_type"])


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY epoch >= 15000 OR (epoch = max(epoch) OVER (PARTITION BY user_id, event_type) AND epoch % 2 = 0)")
def stream_compaction(spark, sf_dir):
    target = I.VersionedFolder(spark, folder(spark), ["user_id", "event_type", "epoch"])
    I.ingest(event_files(spark, sf_dir), target, folder(spark)).awaitTermination()
    return target.compact_to(folder(spark), 15000).rows()


def streamed(spark, df: DataFrame) -> DataFrame:
    """The result of a streaming aggregation over all that is there: each batch's whole result replaces the one before."""
    path = folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result={number}")
        last[0] = number

    last = [0]
    df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/result={last[0]}")


@query(f"WITH {VERSIONS} SELECT epoch % 16 AS queue, count(*) AS n FROM v GROUP BY queue")
def stream_queue_counts(spark, sf_dir):
    return streamed(spark, I.stream_queues(event_files(spark, sf_dir), F.pmod("epoch", F.lit(16))))


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch DESC) = 1")
def stream_newest(spark, sf_dir):
    return streamed(spark, I.newest_in_stream(event_files(spark, sf_dir), ["user_id", "event_type"]))


@query(f"WITH {VERSIONS}, n AS (SELECT user_id, epoch % 9 AS v, sum(CASE WHEN epoch % 2 = 1 THEN -1 ELSE 1 END) AS n FROM v GROUP BY ALL) SELECT user_id, min(CASE WHEN n > 0 THEN v END) AS min FROM n GROUP BY user_id")
def stream_min_retract(spark, sf_dir):
    rows = event_files(spark, sf_dir).select("user_id", F.pmod("epoch", F.lit(9)).alias("v"), F.when(V.is_tombstone(), -1).otherwise(1).alias("w"))
    return streamed(spark, I.stream_net_counts(rows, ["user_id"], "v", "w")).groupBy("user_id").agg(F.min(F.when(F.col("n") > 0, F.col("v"))).alias("min"))


@query(f"WITH {VERSIONS} SELECT user_id, event_type FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) = 1 AND epoch % 2 = 0")
def stream_keyed_changes(spark, sf_dir):
    """A keyed table kept by changes: a user's last event type, or nothing after a tombstone."""
    path, files, checkpoint = folder(spark), folder(spark), folder(spark)
    rows = versions(spark, sf_dir)
    for k, (lo, hi) in enumerate([(0, 3000), (3000, 9000), (9000, 1 << 60)]):  # a part, of as many files as it takes, is there before the next: the stream goes on with a batch of it
        rows.where((F.col("epoch") >= lo) & (F.col("epoch") < hi)).repartition("epoch").write.parquet(f"{files}/part={k}")
        changes = spark.readStream.schema(rows.schema).parquet(f"{files}/part=*")
        I.apply_changes(changes.withColumn("gone", V.is_tombstone()), path, "user_id", "epoch", "gone", checkpoint).awaitTermination()
    return I.latest_snapshot(spark, path).select("user_id", "event_type")


# Hashes, types, filters ------------------------------------------------------------------------------------------

BYTES = "list_transform(string_split({0}, ''), lambda c: ord(c)::UBIGINT::HUGEINT)"
FNV32 = "list_reduce(list_prepend(2166136261::HUGEINT, {0}), lambda h, b: xor(((h * 16777619) % 4294967296)::BIGINT, b::BIGINT)::HUGEINT)::BIGINT"
FNV64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {0}), lambda h, b: xor((h * 1099511628211) % 18446744073709551616, b))"
CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))"


@query(f"SELECT p_partkey, {FNV32.format(BYTES.format('p_name'))} AS fnv32, {FNV64.format(BYTES.format('p_name'))}::VARCHAR AS fnv64 FROM part")
def fnv_hashes(spark, sf_dir):
    name = F.col("p_name").cast("binary")
    unsigned = F.conv(F.hex(S.fnv1_64(name)), 16, 10)
    return table(spark, sf_dir, "part").select("p_partkey", S.fnv1_32(name).alias("fnv32"), unsigned.alias("fnv64"))


@query(f"SELECT event_id, {CRC.format('event_id::VARCHAR')} AS crc FROM events")
def raw_checksums(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.raw_crc(F.col("event_id")).alias("crc"))


@query(f"SELECT event_id, xor(c >> 10, c & 1023) & 1023 AS folded, ({'{}'}) AS part FROM (SELECT event_id, {CRC.format('event_id::VARCHAR')} AS c FROM events)".format("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (h * 31 + b) & 4294967295) % 7 + 1"))
def folded_and_partitioned(spark, sf_dir):
    """A hash of fewer bits, and the partition of a clustered table that a key belongs to."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.xor_folded(S.raw_crc(key), 10).alias("folded"), S.partition_of(key, 7).alias("part"))


@query("SELECT c_custkey, 'bigint' AS key_type, octet_length(c_custkey::VARCHAR::BLOB)::BIGINT AS key_size, 'string' AS name_type, octet_length(c_name::BLOB)::BIGINT AS name_size FROM customer")
def types_and_sizes(spark, sf_dir):
    key, name = S.type_and_size(F.col("c_custkey")), S.type_and_size(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", key["type"].alias("key_type"), key["size"].alias("key_size"), name["type"].alias("name_type"), name["size"].alias("name_size"))


@query("SELECT o_orderkey, o_orderkey // 1000 AS page, (o_orderkey % 1000)::INT AS slot, 8::BIGINT AS size FROM orders")
def row_ids(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", S.row_id(S.floor_div(key, 1000), F.pmod(key, F.lit(1000)), F.lit(8)).alias("rid"))
    return rows.select("o_orderkey", "rid.page", "rid.slot", "rid.size")


@query("SELECT o_orderkey, 1152921504606846976 + o_orderkey // 512 * 512 AS down, 1152921504606846976 + (o_orderkey + 511) // 512 * 512 AS up FROM orders")
def large_rounding(spark, sf_dir):
    """Whole numbers beyond what doubles hold."""
    key = F.col("o_orderkey") + F.lit(1 << 60)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.rounded_down(key, 512).alias("down"), S.rounded_up(key, 512).alias("up"))


@query("SELECT o_orderkey, 2 * o_orderkey + 1 AS value FROM orders")
def user_function(spark, sf_dir):
    """A function that a user has added, by its name."""
    registry.OWN.pop("doubled_and_one", None)
    registry.register_function("doubled_and_one", lambda c: c * 2 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", registry.scalar_function("doubled_and_one")(F.col("o_orderkey")).alias("value"))


class Digits:
    """A table function: a number's decimal digits with their place."""

    def eval(self, number: int):
        for place, digit in enumerate(str(number)):
            yield place, int(digit)


@query("SELECT n_nationkey, (u - 1)::INT AS place, substr(n_nationkey::VARCHAR, u::INT, 1)::INT AS digit FROM (SELECT n_nationkey, unnest(range(1, length(n_nationkey::VARCHAR) + 1)) AS u FROM nation)")
def user_table_function(spark, sf_dir):
    registry.register_table_function(spark, "digits", Digits, "place int, digit int")
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nations_of_user_table_function")
    return spark.sql("SELECT n_nationkey, place, digit FROM _nations_of_user_table_function, LATERAL digits(n_nationkey)")


@query("SELECT 0::BIGINT AS missed, true AS few_false")
def bloom_contract(spark, sf_dir):
    """Of what was inserted nothing is missed; of the rest about as many are taken for inserted as the size promises."""
    rows = table(spark, sf_dir, "orders", "o_orderkey").withColumn("other", -F.col("o_orderkey") - 1)
    bits, hashes = sketches.bloom_size(max(1, rows.count()), 0.01)
    bloom = sketches.bloom_filter(rows, "o_orderkey", bits, hashes)
    own = sketches.bloom_maybe(rows, "o_orderkey", bloom, bits, hashes).agg(F.count_if(~F.col("maybe")).alias("missed"))
    others = sketches.bloom_maybe(rows, "other", bloom, bits, hashes).agg((F.count_if("maybe") <= 0.03 * F.count(F.lit(1))).alias("few_false"))
    return own.crossJoin(others)


# Pages, routing, graphs --------------------------------------------------------------------------------------------


@query(f"SELECT {PAGES}, count(*) AS n FROM events GROUP BY page")
def page_counts(spark, sf_dir):
    return dataflow.group_counts(encodings.pages(table(spark, sf_dir, "events"), "event_id", 1000), "page")


@query(f"SELECT page, v AS value, 5 AS slot FROM (SELECT {PAGES}, user_id % 3 AS v, row_number() OVER (PARTITION BY (event_id // 1000) ORDER BY event_id) - 1 AS pos FROM events) WHERE pos = 5")
def page_slot(spark, sf_dir):
    rows = encodings.pages(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("v")), "event_id", 1000)
    return encodings.read_slot(encodings.run_lengths(rows, ["page"], "event_id", "v"), 5)


@query("SELECT event_id, user_id FROM events WHERE user_id = 7")
def page_find(spark, sf_dir):
    return keyed.matching(table(spark, sf_dir, "events", "event_id", "user_id"), user_id=7)


@query(f"WITH c AS (SELECT event_id, {CRC.format('event_id::VARCHAR')} % 16 AS k FROM events) SELECT event_id, (event_id // 1000) % 4 AS by_page, k AS by_key FROM c")
def routed_rows(spark, sf_dir):
    """Queues by the page of a record, and by the key of a logged operation."""
    rows = table(spark, sf_dir, "events", "event_id").withColumn("operation", F.when(F.col("event_id") % 2 == 0, "insert").otherwise("remove"))
    paged = dataflow.routed(rows, dataflow.by_page("event_id", 1000), 4).withColumnRenamed("queue", "by_page")
    return dataflow.routed(paged, dataflow.by_operation_key("operation", ("insert", "remove"), "event_id"), 16).select("event_id", "by_page", F.col("queue").alias("by_key"))


@query("SELECT count(DISTINCT user_id) AS groups, count(*) AS rows FROM events")
def distinct_groups(spark, sf_dir):
    return dataflow.distinct_groups(table(spark, sf_dir, "events"), "user_id")


@query("SELECT user_id, count(*) AS n, max(event_id) - min(event_id) AS span FROM events GROUP BY user_id")
def group_apply(spark, sf_dir):
    """A user's function of each group."""
    span = lambda rows: rows.groupby("user_id", as_index=False).agg(n=("event_id", "size"), span=("event_id", lambda x: x.max() - x.min()))
    return dataflow.group_apply(table(spark, sf_dir, "events", "user_id", "event_id"), "user_id", span, "user_id long, n long, span long")


PARTS = f"WITH RECURSIVE {CUSTOMER_EDGES}, d AS (SELECT DISTINCT src, dst FROM e), r AS (SELECT 5::BIGINT AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN d ON node = src WHERE hop < 4), v AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)"


@query(f"{PARTS}, o AS (SELECT src, count(*) FILTER (dst % 8 = src % 8) AS l, count(*) FILTER (dst % 8 <> src % 8) AS s FROM d GROUP BY src) SELECT hop, (node % 8)::INT AS partition, count(*) AS visited, coalesce(sum(l), 0)::BIGINT AS local, coalesce(sum(s), 0)::BIGINT AS sent FROM v LEFT JOIN o ON node = src GROUP BY ALL")
def partitioned_traversal(spark, sf_dir):
    return graph.partitioned_traversal(customer_edges(spark, sf_dir), source(spark), 8, 4)


@query("SELECT * FROM (VALUES ('ring', 500::BIGINT, 3), ('random', 500, 3), ('hot', 500, 3)) t(kind, nodes, outdegree)")
def generated_graphs(spark, sf_dir):
    """Three kinds of graphs; on a ring every node is reached, so the count is of those."""
    ring = graph.ring_graph(spark, 500, 3)
    reached = graph.reachable(graph.edges_of(ring, "id", "neighbors"), spark.range(1).select(F.col("id").alias("node")))
    counted = [reached.agg(F.lit("ring").alias("kind"), F.count(F.lit(1)).alias("nodes"), F.lit(3).alias("outdegree"))]
    for kind, made in (("random", graph.random_graph(spark, 500, 3)), ("hot", graph.hot_set_graph(spark, 500, 3, 20, 0.8))):
        counted.append(made.where("forall(neighbors, x -> x between 0 and 499)").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("nodes"), F.max(F.size("neighbors")).alias("outdegree")))
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey IN (3, 8) UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey IN (3, 8)")
def object_graph(spark, sf_dir):
    """Objects that refer to each other: two nations, and what they reach."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("region"), F.array(F.concat(F.lit("n"), "n_nationkey")).alias("others"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("region"), F.array().cast("array<string>").alias("others"))
    roots = spark.createDataFrame([("n3",), ("n8",)], "node string")
    return graph.persisted(nations.unionByName(regions), "id", ["region", "others"], roots).select("id")


@query("SELECT 5000::BIGINT AS rows, true AS inside, true AS even")
def random_numbers(spark, sf_dir):
    made = formats.random_numbers(spark, 5000, 10, seed=3)
    each = made.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    return each.agg(F.sum("c").alias("rows"), F.every(F.col("n").between(0, 9)).alias("inside"), (F.every(F.col("c").between(350, 650)) & (F.count(F.lit(1)) == 10)).alias("even"))


@query("SELECT 1000::BIGINT AS orders, 1000::BIGINT AS added, true AS ends_follow")
def generated_ops(spark, sf_dir):
    """A generated stream of operations: every order is added once, and ends later."""
    made = formats.generated_ops(spark, 1000)
    at = F.col("year") * 364 + F.col("week") * 7 + F.col("day")
    each = made.groupBy("order").agg(F.count_if(F.col("mode") == "add").alias("a"), F.max(F.when(F.col("mode").isin("delete", "deliver"), at)).alias("e"), F.max(F.when(F.col("mode") == "add", at)).alias("s"))
    return each.agg(F.count(F.lit(1)).alias("orders"), F.sum("a").alias("added"), F.every(F.col("e") > F.col("s")).alias("ends_follow"))
