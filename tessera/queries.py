"""The engine's queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalar as S
from .operators import dataflow, encodings, graph, keyed, sketches, versioned as V
from .plans.parser import parse
from .plans.planner import Planner
from .sources.catalog import Engine
from .sources.formats import tuple_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def language(name: str, text: str, sql: str) -> None:
    """Registers a query of the engine's own language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        planner = Planner(lambda t: table(spark, sf_dir, t), lambda: ["nation", "region"])
        return planner.plan(parse(f"query {text}")[0].source).output()

    run.__name__ = name
    query(sql)(run)


# The query language ---------------------------------------------------------------------------------

language("scan", "nation", "SELECT * FROM nation")
language("select_eq", '{s ($2="F") orders}', "SELECT * FROM orders WHERE o_orderstatus = 'F'")
language("select_conj", '{s ($2="F",$5="1-URGENT") orders}', "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
language("select_disj", '{s ($2="F",$5="1-URGENT")|($o_orderkey=7) orders}', "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderkey = 7")
language("select_const_col", '{s ("BUILDING"=$4) customer}', "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
language("select_col_col", "{s ($0=$2) nation}", "SELECT * FROM nation WHERE n_nationkey = n_regionkey")
language("select_named", "{s ($c_nationkey=3) customer}", "SELECT * FROM customer WHERE c_nationkey = 3")
language("select_const_true", "{s (1=1) region}", "SELECT * FROM region")
language("select_const_false", '{s ("a"="b") region}', "SELECT * FROM region WHERE false")
language("select_empty_predicate", "{s () region}", "SELECT * FROM region")
language("select_type_mismatch", '{s ($0="7") orders}', "SELECT * FROM orders WHERE false")
language("select_identifier", "{s ($1=AFRICA) region}", "SELECT * FROM region WHERE false")
language("select_exists", "{s ($1) nation}", "SELECT * FROM nation")
language("select_short_tuple", "{s ($9) nation}", "SELECT * FROM nation WHERE false")
language("project_reorder", "{p ($2,$0) part}", "SELECT p_brand, p_partkey FROM part")
language("project_repeat", "{p ($0,$4,$0) part}", "SELECT p_partkey, p_size, p_partkey AS p_partkey_1 FROM part")
language("project_bag", "{p ($c_mktsegment) customer}", "SELECT c_mktsegment FROM customer")
language("join_equi", "{p ($0,$6,$9) {j ($0=$0) orders lineitem}}", "SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
language("join_multi", "{p ($0,$5) {j ($0=$0,$2=$2) nation nation}}", "SELECT a.n_nationkey, b.n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey")
language("join_const_side", '{p ($0,$1,$5) {j ($1=$0,$2="F",3=$2) orders customer}}', "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' AND c_nationkey = 3")
language("join_cross", "{j () region nation}", "SELECT * FROM region CROSS JOIN nation")
language("join_constant_false", "{j (0=1) region nation}", "SELECT * FROM region CROSS JOIN nation WHERE false")
language("join_self", "{p ($0,$4) {j ($2=$2) nation nation}}", "SELECT a.n_nationkey, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
language("join_positional", "{j ($0) region nation}", "SELECT * FROM region JOIN nation ON r_regionkey = n_nationkey")
language("join_natural", "{p ($0,$4) {j ($n_regionkey) nation nation}}", "SELECT a.n_nationkey, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
language("join_of_union", "{p ($0,$1,$3) {j ($0=$2) {p ($r_regionkey,$r_name) region}|{p ($0,$1) nation} nation}}", "SELECT r_regionkey, r_name, n_name FROM (SELECT * FROM region UNION ALL SELECT n_nationkey, n_name FROM nation) a JOIN nation ON r_regionkey = n_regionkey")
language("nested_spj", '{p ($0,$1,$11) {j ($5=$0) {j ($0=$1) {s ($4="BUILDING") customer} {s ($2="F") orders}} lineitem}}', "SELECT c_custkey, c_name, l_orderkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
language("union_all", "{p ($0,$1) nation}|region|region", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT * FROM region UNION ALL SELECT * FROM region")
language("star_scan", "*", "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region")


@query("SELECT * FROM (VALUES ('TABLES', 0::BIGINT, 0, 0::BIGINT, [3, 2, 2, 2, 0]), ('nation', 1, 0, 3, [2, 3, 2]), ('region', 2, 0, 2, [2, 3])) t(name, page, slot, size, types)")
def catalog_scan(spark, sf_dir):
    return Engine(spark, {t: table(spark, sf_dir, t) for t in ("nation", "region")}).query("TABLES")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey NOT IN (5, 7, 9) UNION ALL SELECT * FROM (VALUES (7, 'new', 1), (-1, 'added', 2))")
def language_dml(spark, sf_dir):
    engine = Engine(spark, {"customer": table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")})
    engine.run('insert customer (7,"old",1) insert customer (7,"new",1) insert customer (-1,"added",2) delete customer (5,0) delete customer (9)')
    return engine.query("customer")


# Keyed tables -----------------------------------------------------------------------------------------


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")


def changed_customers(spark, sf_dir):
    """Every third customer with a new name, and as many new ones."""
    old = customers(spark, sf_dir).where("c_custkey % 3 = 0")
    shift = F.explode(F.array(F.lit(0), F.lit(1_000_000_000_000)))
    return old.withColumn("_shift", shift).select((F.col("c_custkey") + F.col("_shift")).alias("c_custkey"), F.concat(F.lit("changed "), "c_name").alias("c_name"), "c_nationkey")


CHANGED = "changed AS (SELECT c_custkey + s AS c_custkey, 'changed ' || c_name AS c_name, c_nationkey FROM customer, (VALUES (0::BIGINT), (1000000000000)) t(s) WHERE c_custkey % 3 = 0)"
OLD = "old AS (SELECT c_custkey, c_name, c_nationkey FROM customer)"


@query("SELECT * FROM customer WHERE c_custkey = 77")
def key_lookup(spark, sf_dir):
    return keyed.lookup(table(spark, sf_dir, "customer"), "c_custkey", 77)


@query(f"WITH {OLD}, {CHANGED} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM changed) UNION ALL SELECT * FROM changed")
def upsert(spark, sf_dir):
    return keyed.upsert(customers(spark, sf_dir), changed_customers(spark, sf_dir), "c_custkey")


@query(f"WITH {OLD}, {CHANGED} SELECT *, c_custkey IN (SELECT c_custkey FROM old) AS replaced FROM changed")
def upsert_told(spark, sf_dir):
    return keyed.upsert_told(customers(spark, sf_dir), changed_customers(spark, sf_dir), "c_custkey")


@query(f"WITH {OLD}, {CHANGED} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM changed)")
def delete_by_key(spark, sf_dir):
    return keyed.delete_keys(customers(spark, sf_dir), changed_customers(spark, sf_dir), "c_custkey")


@query(f"WITH {OLD}, {CHANGED} SELECT * FROM old UNION ALL SELECT * FROM changed WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def insert_if_absent(spark, sf_dir):
    return keyed.insert_absent(customers(spark, sf_dir), changed_customers(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_custkey AND n_regionkey = c_nationkey)")
def cond_delete(spark, sf_dir):
    told = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_custkey"), F.col("n_regionkey").alias("c_nationkey"))
    return keyed.delete_matching(customers(spark, sf_dir), told, "c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 6 = 0")
def move_rows(spark, sf_dir):
    rows = customers(spark, sf_dir)
    even, odd = rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1")
    return keyed.move_keys(even, odd, rows.where("c_custkey % 6 = 0"), "c_custkey")[1]


@query("SELECT o_orderkey, o_custkey + coalesce(s.n, 0) AS o_custkey FROM orders LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END)::BIGINT AS n FROM lineitem GROUP BY ALL) s ON l_orderkey = o_orderkey")
def increments(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("step"))
    return keyed.counters(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), steps, "o_orderkey", "o_custkey", "step")


@query("SELECT p_partkey, substr(p_name, 1, 2) || 'XYZ' || substr(p_name, 6) AS p_name FROM part")
def overwrite_part(spark, sf_dir):
    return keyed.overwrite_range(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name", 2, F.lit("XYZ"), 3)


for _mode, _where, _best in (("equal", "= 100", "min"), ("gteq", ">= 100", "min"), ("lteq", "<= 100", "max"), ("greater", "> 100", "min"), ("less", "< 100", "max"), ("first", "IS NOT NULL", "min"), ("last", "IS NOT NULL", "max")):

    def _run(spark, sf_dir, mode=_mode):
        return keyed.ordered_lookup(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey", mode, 100)

    _run.__name__ = f"ordered_{_mode}"
    query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT {_best}(o_orderkey) FROM orders WHERE o_orderkey {_where})")(_run)


@query("SELECT event_id, user_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbor(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return keyed.neighbours(rows.withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at", "event_id").drop("at", "ts")


ASOF = "SELECT e.event_id, (SELECT {best}(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id {test} e.event_id) AS near FROM events e WHERE e.event_type <> 'purchase'"


def asof(spark, sf_dir, forward):
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    other = rows.where("event_type = 'purchase'").withColumn("bought", F.col("event_id"))
    left = rows.where("event_type <> 'purchase'").select("event_id", "user_id")
    return keyed.as_of(left, other, ["user_id"], "event_id", "bought", "near", forward).select("event_id", "near")


@query(ASOF.format(best="max", test="<="))
def asof_le(spark, sf_dir):
    return asof(spark, sf_dir, False)


@query(ASOF.format(best="min", test=">="))
def asof_ge(spark, sf_dir):
    return asof(spark, sf_dir, True)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND p_size > 20")
def prefix_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return keyed.prefix_scan(rows, "p_name", "red", F.col("p_size") > 20).select("p_partkey", "p_name")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def map_fetch(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"))


@query("SELECT user_id, event_type, max(event_id) AS last_id FROM events GROUP BY ALL")
def nested_map(spark, sf_dir):
    """Maps of maps, built up and read back."""
    inner = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"))
    outer = inner.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.create_map(F.lit("last"), "last_id")))).alias("m"))
    return outer.select("user_id", F.explode("m").alias("event_type", "v")).select("user_id", "event_type", F.col("v")["last"].alias("last_id"))


# Versioned tables ---------------------------------------------------------------------------------------


def versions(spark, sf_dir):
    """Events as versions of (user, type): every seventh is a tombstone."""
    return table(spark, sf_dir, "events").select("user_id", "event_type", (V.epoch_of("event_id") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("epoch"))


def components(spark, sf_dir):
    """Three overlapping components, the newest first."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))
    part = lambda lo, hi, add: rows.where(F.pmod("l_orderkey", F.lit(10)).between(lo, hi)).withColumn("quantity", F.col("quantity") + add * (F.col("l_orderkey") % 2).cast("int"))
    return [part(0, 4, 100), part(3, 7, 50), part(5, 9, 0)]


VERSIONS = "v AS (SELECT user_id, event_type, 2 * event_id + (event_id % 7 = 0)::INT AS epoch FROM events)"
COMPONENTS = "li AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS quantity FROM lineitem), c AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, (quantity + {a} * (l_orderkey % 2))::INT AS quantity, {k} AS component FROM li WHERE l_orderkey % 10 BETWEEN {lo} AND {hi}" for k, (lo, hi, a) in enumerate([(0, 4, 100), (3, 7, 50), (5, 9, 0)])) + ")"


@query(f"WITH {COMPONENTS} SELECT DISTINCT l_orderkey, l_linenumber, quantity FROM c")
def merge_components(spark, sf_dir):
    return V.merged(components(spark, sf_dir))


@query(f"WITH {COMPONENTS} SELECT l_orderkey, l_linenumber, quantity FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY component, quantity) = 1")
def merge_newest(spark, sf_dir):
    return V.newest(components(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query(f"WITH {VERSIONS} SELECT * FROM v WHERE epoch <= 9000 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch DESC) = 1 AND epoch % 2 = 0")
def snapshot_read(spark, sf_dir):
    return V.snapshot(versions(spark, sf_dir), ["user_id", "event_type"], 9000)


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch DESC) = 1 AND epoch % 2 = 0")
def tombstone_view(spark, sf_dir):
    return V.snapshot(versions(spark, sf_dir), ["user_id", "event_type"])


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY epoch >= 15000 OR (epoch = max(epoch) OVER (PARTITION BY user_id, event_type) AND epoch % 2 = 0)")
def version_gc(spark, sf_dir):
    return V.garbage_collected(versions(spark, sf_dir), 15000)


@query(f"WITH {VERSIONS} SELECT * FROM v QUALIFY epoch >= 15000 OR (epoch = max(CASE WHEN epoch < 15000 THEN epoch END) OVER (PARTITION BY user_id, event_type) AND epoch % 2 = 0)")
def version_gc_snapshots(spark, sf_dir):
    return V.garbage_collected(versions(spark, sf_dir), 15000, snapshots=True)


FOUND = f"WITH {COMPONENTS}, p AS (SELECT DISTINCT l_orderkey, l_linenumber, quantity FROM li) SELECT l_orderkey, l_linenumber, quantity, min(component) AS component FROM c JOIN p USING (l_orderkey, l_linenumber, quantity)"


@query(f"{FOUND} GROUP BY ALL")
def lsm_find(spark, sf_dir):
    return V.find(components(spark, sf_dir), probes(spark, sf_dir))


@query(f"{FOUND} WHERE component = 0 GROUP BY ALL")
def lsm_find_c0(spark, sf_dir):
    return V.find(components(spark, sf_dir)[:1], probes(spark, sf_dir))


def probes(spark, sf_dir):
    """All line items as they were before any component changed them."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))


@query(f"WITH {COMPONENTS} SELECT DISTINCT l_orderkey, l_linenumber, quantity FROM c WHERE (l_orderkey, l_linenumber, quantity) >= (500, 3, 10)")
def lsm_gte(spark, sf_dir):
    return V.find_from(components(spark, sf_dir), ["l_orderkey", "l_linenumber", "quantity"], [500, 3, 10])


@query(f"WITH {COMPONENTS} SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, quantity FROM c)")
def lsm_count(spark, sf_dir):
    return V.count_merged(components(spark, sf_dir))


@query("WITH p AS (SELECT min(o_orderkey) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY o_orderkey // 100) SELECT * FROM p WHERE o_orderkey = (SELECT max(o_orderkey) FROM p WHERE o_orderkey <= 777)")
def page_floor(spark, sf_dir):
    """Pages of all orders, each with its first row."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    pages = orders.groupBy(S.floor_div(F.col("o_orderkey"), 100)).agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_custkey", "o_orderkey").alias("o_custkey"))
    return V.floor_page(pages.select("o_orderkey", "o_custkey"), "o_orderkey", 777)


def ops(spark, sf_dir):
    mode = F.when(F.col("o_orderkey") % 10 == 0, "delete").when(F.col("o_orderkey") % 10 < 4, "deliver").when(F.col("o_orderkey") % 10 == 4, "status").otherwise("add")
    return table(spark, sf_dir, "orders").select(mode.alias("mode"), F.col("o_orderkey").alias("xid"), F.col("o_custkey").alias("cust"), F.lit(1).alias("status"))


OPS = "ops AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'delete' WHEN o_orderkey % 10 < 4 THEN 'deliver' WHEN o_orderkey % 10 = 4 THEN 'status' ELSE 'add' END AS mode, o_orderkey AS xid, o_custkey AS cust, 1 AS status FROM orders)"


@query(f"WITH {OPS} SELECT cust, status, 2 * xid AS epoch FROM ops WHERE mode = 'add' UNION ALL SELECT cust, status, 2 * xid + 1 FROM ops WHERE mode = 'delete' UNION ALL SELECT cust, status, xid FROM ops WHERE mode = 'deliver' UNION ALL SELECT cust, 0, 2 * xid + 1 FROM ops WHERE mode = 'deliver'")
def op_stream_apply(spark, sf_dir):
    return V.op_stream(ops(spark, sf_dir), "mode", "xid", ["cust", "status"], "status")


@query(f"WITH {OPS} SELECT xid, CASE WHEN min(mode) = 'add' THEN 2 * (xid - 1) ELSE 2 * (xid - 1) + 1 END AS horizon FROM ops GROUP BY xid")
def op_stream_horizons(spark, sf_dir):
    return V.horizons(ops(spark, sf_dir), "mode", "xid")


# Aggregates, sketches, encodings ---------------------------------------------------------------------------


@query("SELECT l_suppkey, list(l_orderkey ORDER BY l_orderkey) AS values FROM lineitem GROUP BY l_suppkey")
def group_collect(spark, sf_dir):
    return dataflow.group_collect(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


@query("SELECT l_suppkey, l_orderkey FROM lineitem")
def group_flat(spark, sf_dir):
    return dataflow.group_flat(table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey"), "l_suppkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def group_counts(spark, sf_dir):
    return dataflow.group_counts(table(spark, sf_dir, "lineitem"), "l_partkey")


def min_changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("v"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("w"))


CHANGES = "ch AS (SELECT user_id, event_id, floor(value)::BIGINT AS v, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS w FROM events)"


@query(f"WITH {CHANGES}, n AS (SELECT user_id, v, sum(w) AS n FROM ch GROUP BY ALL) SELECT user_id, min(CASE WHEN n > 0 THEN v END) AS min FROM n GROUP BY user_id")
def min_retract(spark, sf_dir):
    return sketches.retractable_min(min_changes(spark, sf_dir), ["user_id"], "v", "w")


@query(f"WITH {CHANGES}, n AS (SELECT user_id, v, sum(w) AS n FROM ch GROUP BY ALL) SELECT user_id, coalesce(min(CASE WHEN n > 0 THEN v END), 9223372036854775807) AS min FROM n GROUP BY user_id")
def multiset_min(spark, sf_dir):
    return sketches.multiset_min(min_changes(spark, sf_dir), ["user_id"], "v", "w")


@query(f"WITH {CHANGES}, s AS (SELECT user_id, v, event_id AS a, lead(event_id) OVER w AS b, sum(w) OVER w AS n FROM ch WINDOW w AS (PARTITION BY user_id, v ORDER BY event_id)) SELECT c.user_id, c.event_id, c.v, c.w, min(s.v) AS min FROM ch c LEFT JOIN s ON s.user_id = c.user_id AND s.n > 0 AND s.a <= c.event_id AND (s.b IS NULL OR s.b > c.event_id) GROUP BY ALL")
def running_min_retract(spark, sf_dir):
    return sketches.running_min(min_changes(spark, sf_dir), ["user_id"], "event_id", "v", "w")


@query("SELECT max(o_orderkey) AS most, min(o_orderkey) AS least, count(*) AS n FROM orders")
def key_extremes(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("most"), F.min("o_orderkey").alias("least"), F.count(F.lit(1)).alias("n"))


PAGES = "(event_id // 1000) AS page"


@query(f"WITH e AS (SELECT event_id, {PAGES}, user_id % 3 AS v FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY event_id) - 1 AS pos, CASE WHEN lag(v) OVER (PARTITION BY page ORDER BY event_id) = v THEN 0 ELSE 1 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY event_id) AS g FROM r) SELECT page, (g - 1)::BIGINT AS run, min(pos) AS start, count(*) AS copies, min(v) AS value FROM g GROUP BY page, g")
def rle_runs(spark, sf_dir):
    rows = encodings.pages(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("v")), "event_id", 1000)
    return encodings.run_lengths(rows, ["page"], "event_id", "v")


@query("SELECT event_id, user_id % 3 AS v FROM events")
def rle_round_trip(spark, sf_dir):
    rows = encodings.pages(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("v")), "event_id", 1000)
    runs = encodings.run_lengths(rows, ["page"], "event_id", "v", longest=2)
    return encodings.expanded_runs(runs, ["page"]).select((F.col("page") * 1000 + F.col("position")).alias("event_id"), F.col("value").alias("v"))


@query(f"WITH e AS (SELECT event_id, {PAGES}, user_id, first_value(user_id) OVER (PARTITION BY (event_id // 1000) ORDER BY event_id) AS base FROM events) SELECT *, NOT (user_id - base BETWEEN 0 AND 255) AS exception, CASE WHEN user_id - base BETWEEN 0 AND 255 THEN user_id - base END AS delta FROM e")
def for_deltas(spark, sf_dir):
    return encodings.frame_of_reference(encodings.pages(table(spark, sf_dir, "events", "event_id", "user_id"), "event_id", 1000), ["page"], "event_id", "user_id", 255)


def intervals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("start"), (F.col("l_orderkey") * 3 + F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("stop"), F.when(F.col("l_linenumber") == 7, -1).otherwise(1).alias("w"))


COVERAGE = "i AS (SELECT l_orderkey * 3 + l_linenumber AS a, l_orderkey * 3 + l_linenumber + l_quantity::BIGINT AS b, CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END AS w FROM lineitem), t AS (SELECT position, sum(delta)::BIGINT AS delta FROM (SELECT a // 4 * 4 AS position, w AS delta FROM i UNION ALL SELECT (b + 3) // 4 * 4, -w FROM i) GROUP BY position HAVING sum(delta) <> 0), r AS (SELECT position, delta, (sum(delta) OVER (ORDER BY position) - delta)::BIGINT AS pins FROM t)"


@query(f"WITH {COVERAGE} SELECT * FROM r")
def range_coverage(spark, sf_dir):
    return encodings.coverage(intervals(spark, sf_dir), weight="w", quantum=4)


@query(f"WITH {COVERAGE} SELECT coalesce(sum(n - position), 0)::BIGINT AS covered FROM (SELECT *, lead(position) OVER (ORDER BY position) AS n FROM r) WHERE pins + delta > 0")
def range_covered(spark, sf_dir):
    return encodings.covered_length(encodings.coverage(intervals(spark, sf_dir), weight="w", quantum=4))


LOG2 = "CASE WHEN {0} <= 0 THEN 0 ELSE length(bin(({0})::BIGINT)) - 1 END"
HIST = f"h AS (SELECT {LOG2.format('l_extendedprice::BIGINT')} AS bucket, l_returnflag, count(*) AS n FROM (SELECT trunc(l_extendedprice)::BIGINT AS l_extendedprice, l_returnflag FROM lineitem) GROUP BY ALL)"


def prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("long").alias("price"))


@query(f"WITH {HIST} SELECT * FROM h")
def log2_histogram(spark, sf_dir):
    return sketches.log2_histogram(prices(spark, sf_dir), "price", ["l_returnflag"])


@query(f"WITH {HIST}, r AS (SELECT l_returnflag, bucket, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h) SELECT l_returnflag, min(bucket) AS bucket, pow(2.0, min(bucket)) / 1e6 AS value FROM r WHERE run >= total * 90 // 100 GROUP BY l_returnflag")
def hist_percentile(spark, sf_dir):
    return sketches.histogram_percentile(sketches.log2_histogram(prices(spark, sf_dir), "price", ["l_returnflag"]), 90, ["l_returnflag"])


EMD = "a AS (SELECT bucket, n FROM h WHERE l_returnflag = 'A'), b AS (SELECT bucket, n FROM h WHERE l_returnflag = 'N'), m AS (SELECT bucket, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (bucket))"


def two_histograms(spark, sf_dir):
    h = sketches.log2_histogram(prices(spark, sf_dir), "price", ["l_returnflag"])
    return [h.where(F.col("l_returnflag") == flag).select("bucket", "n") for flag in ("A", "N")]


@query(f"WITH {HIST}, {EMD} SELECT sum(abs(s))::BIGINT AS distance FROM (SELECT sum(d) OVER (ORDER BY bucket) AS s FROM (SELECT bucket, (SELECT sum(y) FROM m) * x - y AS d FROM m))")
def hist_emd(spark, sf_dir):
    return sketches.histogram_distance(*two_histograms(spark, sf_dir))


@query(f"WITH {HIST}, {EMD} SELECT sum(abs(s))::BIGINT AS distance FROM (SELECT sum(d) OVER (ORDER BY bucket) AS s FROM (SELECT bucket, ({LOG2.format('x')}) - ({LOG2.format('y')}) AS d FROM m))")
def hist_emd_log(spark, sf_dir):
    return sketches.histogram_distance(*two_histograms(spark, sf_dir), logarithmic=True)


MD5 = "('0x' || substr(md5({0}::VARCHAR), {1}, 8))::BIGINT"
BLOOM = f"bulk AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45), s AS (SELECT ceil(greatest(count(*), 1) * ln(0.01) / ln(0.6185))::BIGINT AS bits, greatest(count(*), 1) AS n FROM bulk), k AS (SELECT bits, greatest(1, floor(ln(2) * bits / n))::BIGINT AS hashes FROM s), f AS (SELECT DISTINCT ({MD5.format('l_partkey', 1)} % bits + i * ({MD5.format('l_partkey', 9)} % bits)) % bits AS p FROM bulk, k, range(hashes) t(i))"


@query(f"WITH {BLOOM}, h AS (SELECT p_partkey, ({MD5.format('p_partkey', 1)} % bits + i * ({MD5.format('p_partkey', 9)} % bits)) % bits AS p FROM part, k, range(hashes) t(i)) SELECT p_partkey, bool_and(f.p IS NOT NULL) AS maybe FROM h LEFT JOIN f ON h.p = f.p GROUP BY p_partkey")
def bloom_membership(spark, sf_dir):
    """Parts against a filter of those that were ordered in bulk, sized by their number; approximate, without false negatives. Hashes are told."""
    bulk = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    bits, hashes = sketches.bloom_size(max(1, bulk.count()), 0.01)
    bloom = sketches.bloom_filter(bulk, "l_partkey", bits, hashes, sketches.by_md5)
    return sketches.bloom_maybe(table(spark, sf_dir, "part", "p_partkey"), "p_partkey", bloom, bits, hashes, sketches.by_md5)


@query(f"WITH {BLOOM} SELECT bits, hashes::INT AS hashes, count(*) AS bits_set, pow(count(*) / bits, hashes) AS false_positives FROM f, k GROUP BY bits, hashes")
def bloom_stats(spark, sf_dir):
    bulk = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    bits, hashes = sketches.bloom_size(max(1, bulk.count()), 0.01)
    return sketches.bloom_stats(sketches.bloom_filter(bulk, "l_partkey", bits, hashes, sketches.by_md5), bits, hashes)


# Dataflow and graphs ------------------------------------------------------------------------------------------


@query("SELECT event_id % 16 AS queue, count(*) AS n FROM events GROUP BY queue")
def multiplex_counts(spark, sf_dir):
    return dataflow.queue_counts(table(spark, sf_dir, "events"), "event_id", 16, by_crc=False)


@query("SELECT queue, count(*) AS n FROM (SELECT list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(event_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))) % 16 AS queue FROM events) GROUP BY queue")
def multiplex_crc_counts(spark, sf_dir):
    return dataflow.queue_counts(table(spark, sf_dir, "events"), "event_id", 16)


@query("SELECT event_id, user_id, event_id % 16 AS queue FROM events")
def multiplex_rows(spark, sf_dir):
    return dataflow.multiplex(table(spark, sf_dir, "events", "event_id", "user_id"), "event_id", 16, by_crc=False)


@query("SELECT event_id AS lsn, user_id AS xid, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_lsn FROM events")
def prev_lsn(spark, sf_dir):
    return dataflow.previous_in_transaction(table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("xid")), "xid", "lsn")


def customer_edges(spark, sf_dir):
    """Customers, linked by their orders' numbers; a node for each customer."""
    customers = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("n"))
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(customers)).select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey") * 7) % F.col("n")).alias("dst"))


CUSTOMER_EDGES = "e AS (SELECT o_custkey AS src, (o_custkey * 31 + o_orderkey * 7) % (SELECT max(c_custkey) + 1 FROM customer) AS dst FROM orders)"
HOPS = f"WITH RECURSIVE {CUSTOMER_EDGES}, r AS (SELECT 5::BIGINT AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN e ON node = src WHERE hop < 6), v AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)"


@query(f"WITH RECURSIVE {CUSTOMER_EDGES}, r AS (SELECT 5::BIGINT AS node UNION SELECT dst FROM r JOIN e ON node = src) SELECT node FROM r")
def reachability(spark, sf_dir):
    return graph.reachable(customer_edges(spark, sf_dir), source(spark)).select("node")


@query(f"{HOPS} SELECT hop, count(*) AS n FROM v GROUP BY hop")
def hop_counts(spark, sf_dir):
    return graph.hop_counts(customer_edges(spark, sf_dir), source(spark), 6)


@query(f"WITH RECURSIVE {CUSTOMER_EDGES}, r AS (SELECT 5::BIGINT AS node UNION SELECT dst FROM r JOIN e ON node = src), f AS (SELECT count(*) AS followed FROM e WHERE src IN (SELECT node FROM r)) SELECT count(*) AS visited, any_value(followed) AS followed, any_value(followed) - count(*) + 1 AS skipped FROM r, f")
def traversal_counters(spark, sf_dir):
    edges = customer_edges(spark, sf_dir)
    return graph.traversal_counters(edges, graph.reachable(edges, source(spark)))


def source(spark):
    return spark.range(5, 6).select(F.col("id").alias("node"))


# Scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (t // 364)::BIGINT AS year, (t % 364 // 7)::BIGINT AS week, (t % 7)::BIGINT AS day FROM (SELECT o_orderkey, (1992 + o_orderkey % 7) * 364 + (o_orderkey % 52) * 7 + o_orderkey % 7 + o_custkey % 400 AS t FROM orders)")
def calendar_add(spark, sf_dir):
    key = F.col("o_orderkey")
    at = S.calendar_add(1992 + key % 7, key % 52, key % 7, F.col("o_custkey") % 400)
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at")).select("o_orderkey", "at.year", "at.week", "at.day")


@query("SELECT p_partkey, 100 * ((90000 + (p_partkey // 10) % 20001 + 100 * (p_partkey % 1000)) // 100) AS price FROM part")
def price_formula(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.retail_price(F.col("p_partkey")).alias("price"))


@query("SELECT event_id, 2 * event_id + (event_id % 7 = 0)::INT AS epoch, event_id % 7 = 0 AS dead FROM events")
def epoch_codec(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id").withColumn("epoch", V.epoch_of("event_id", F.col("event_id") % 7 == 0))
    return df.withColumn("dead", V.is_tombstone())


@query("SELECT p_partkey, list_filter(string_split(replace(p_name, 'e', ' '), ' '), lambda x: x <> '') AS parts, string_split(replace(p_name, 'e', ' '), ' ') AS all_parts FROM part")
def split_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.tokens(F.col("p_name"), " e").alias("parts"), S.tokens_with_empty(F.col("p_name"), " e").alias("all_parts"))


@query("SELECT '(' || n_nationkey || ',' || n_name || ',' || n_regionkey || ')' AS value FROM nation")
def tuple_string(spark, sf_dir):
    return tuple_lines(table(spark, sf_dir, "nation"))


@query(f"SELECT o_orderkey, {LOG2.format('o_orderkey')} AS bits FROM orders")
def log2_floor(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.log2_floor(F.col("o_orderkey")).alias("bits"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey & 7 < 3 THEN o_orderkey & 15 ELSE o_orderkey & 7 END AS bucket FROM orders")
def linear_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.linear_bucket(F.col("o_orderkey"), 4, 3).alias("bucket"))


@query("SELECT p_partkey, replace(p_name, ' ', '%20') AS escaped, p_name AS back FROM part")
def uri_escape(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", S.uri_escaped(F.col("p_name")).alias("escaped"))
    return df.withColumn("back", S.uri_unescaped(F.col("escaped")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ',' || c_mktsegment END AS value FROM customer")
def key_value_text(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.key_value_text(F.col("c_name"), value).alias("value"))


@query("SELECT o_orderkey, o_orderkey // 512 * 512 AS down, (o_orderkey + 511) // 512 * 512 AS up FROM orders")
def quantum_rounding(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.rounded_down(key, 512).alias("down"), S.rounded_up(key, 512).alias("up"))
