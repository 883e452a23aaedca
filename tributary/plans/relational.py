"""Queries for each class of the relational surface that raw SQL opens.

Each entry is a DataFrame over the TPC-H-like tables and the same in DuckDB's
SQL. Where both dialects agree the text is shared and goes through
``run_sql``, as a user's SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.scratch import new_path, stored
from tributary.plans.sql import run_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as DataFrames, read on use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _frame(name: str, make: Callable[[Tables], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


def _both(name: str, sql: str, oracle: str | None = None) -> None:
    """The same text on both engines, or Spark's text and DuckDB's."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sql, {t: getattr(Tables(spark, sf_dir), t) for t in TABLES if t in sql})
    ORACLE_SQL[name] = oracle or sql


# --- joins ----------------------------------------------------------------------

_both("join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_both("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
_both("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
_both("join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, n_c, n_s FROM (SELECT c_nationkey, count(*) AS n_c FROM customer WHERE c_acctbal > 8000 GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS n_s FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c_nationkey = s_nationkey")
_frame("join_semi", lambda t: t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_frame("join_anti", lambda t: t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_both("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")


def _range_join(t: Tables) -> DataFrame:
    """Lines shipped within a day after an order's time, by bucketed equi-join: a day's bucket on both sides, then the exact range."""
    orders = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderdate")
    lines = t.lineitem.groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("lines"))  # one row a time: only counts are asked for
    lines = lines.select("l_shipdate", "lines", F.explode(F.array(F.to_date("l_shipdate"), F.date_sub(F.to_date("l_shipdate"), 1))).alias("day"))
    near = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    return orders.join(lines, "day").where(near).groupBy("o_orderkey").agg(F.sum("lines").alias("n"))


_frame("join_range", _range_join, "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 1 DAY GROUP BY o_orderkey")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time: a union and one ordered window, no pairs."""
    carried = F.struct(F.col(right_time).alias("at"), *values)
    lefts = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("__right"))
    rights = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), carried.alias("__right"))
    line = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = lefts.unionByName(rights).withColumn("__found", F.last("__right", ignorenulls=True).over(line)).where("__side = 1")
    return found.select("__left.*", *[F.col(f"__found.{v}").alias(v) for v in values], F.col("__found.at").alias("matched_at"))


def _as_of(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    views = t.events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return as_of(errors, views, "user_id", "ts", "view_ts", ["view_id"])


_frame("join_asof", _as_of, "SELECT e.event_id, e.user_id, e.ts, v.view_id, v.view_ts AS matched_at FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts AS view_ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON e.user_id = v.user_id AND e.ts >= v.view_ts")

# --- subqueries -----------------------------------------------------------------

_both("sub_scalar", "SELECT p_brand, count(*) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) GROUP BY p_brand")
_both("sub_correlated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_both("sub_in_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.09)")
_both("sub_lateral", "SELECT n_name, m.best FROM nation, LATERAL (SELECT max(c_acctbal) AS best FROM customer WHERE c_nationkey = n_nationkey) m")
_both("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 1000000) SELECT count(*) AS n, round(avg(total), 2) AS mean FROM top")
_both("cte_recursive", "WITH RECURSIVE days(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM days WHERE n < 40) SELECT n, total FROM days")

# --- aggregation ----------------------------------------------------------------

_LINES = "round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem"
_both("agg_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_both("agg_rollup", f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_both("agg_cube", f"SELECT l_returnflag, l_linestatus, {_LINES} GROUP BY CUBE (l_returnflag, l_linestatus)")
_both("agg_having_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
_both("agg_tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_both("agg_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(var_pop(p_retailprice), 6) AS vp, round(corr(p_retailprice, p_size), 6) AS c, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
_both("agg_quantile_mode", "SELECT l_returnflag, round(percentile(l_quantity, 0.9), 6) AS p90, min(l_quantity) AS lo FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90, min(l_quantity) AS lo FROM lineitem GROUP BY l_returnflag")
_frame("agg_approx_distinct", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"), (F.abs(F.approx_count_distinct("o_custkey", 0.01) / F.count_distinct("o_custkey") - 1) < 0.05).alias("close")), "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, TRUE AS close FROM orders GROUP BY o_orderpriority")
_both("agg_arg_min_max", "SELECT c_nationkey, min_by(c_name, struct(c_acctbal, c_custkey)) AS poorest, max_by(c_name, struct(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, arg_min(c_name, row(c_acctbal, c_custkey)) AS poorest, arg_max(c_name, row(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey")
_both("agg_strings", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_both("agg_distinct_multi", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS numbers FROM lineitem")

# --- windows --------------------------------------------------------------------

_both("window_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) x WHERE r <= 3")
_both("window_shares", "SELECT s_suppkey, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q FROM supplier")
_both("window_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS head, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_both("window_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS near, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running FROM orders")
_both("window_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")

# --- sets, order, limits, shape -------------------------------------------------

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 6000"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    _both(f"set_{_name}", f"{_A} {_op} {_B}")
_both("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
_both("order_top_per_group", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) x WHERE r <= 3")
_both("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


def _sample(t: Tables) -> DataFrame:
    """Of each flag, all lines, those of a 10 % sample that are none of them, and whether the sample's size is within five deviations."""
    key = ["l_orderkey", "l_linenumber", "l_returnflag"]
    drawn = t.lineitem.sample(0.1, seed=42).select(*key)
    other = drawn.join(t.lineitem.select(*key), key, "left_anti").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("strange"))
    sizes = drawn.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("drawn"))
    every = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    near = F.abs(F.col("drawn") - 0.1 * F.col("n")) < 5 * F.sqrt(0.09 * F.col("n"))
    return every.join(sizes, "l_returnflag", "left").join(other, "l_returnflag", "left").select("l_returnflag", "n", F.coalesce("strange", F.lit(0)).cast("long").alias("strange"), near.alias("near"))


_frame("sample", _sample, "SELECT l_returnflag, count(*) AS n, CAST(0 AS BIGINT) AS strange, TRUE AS near FROM lineitem GROUP BY l_returnflag")
_frame("pivot", lambda t: t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2)).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o")), "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS f, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS o FROM lineitem GROUP BY l_returnflag")
_frame("unpivot", lambda t: t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "value"), "SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
_frame("unnest", lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.round(F.col("x").cast("double"), 5).alias("x")), "SELECT vec_id, i - 1 AS \"at\", round(CAST(embedding[i] AS DOUBLE), 5) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")

# --- scalars --------------------------------------------------------------------

_both(
    "scalar_string",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat(' ', p_type, ' ')) AS t, substring(p_name, 2, 5) AS s, concat_ws('-', p_brand, p_type) AS c, replace(p_name, 'a', '_') AS r, regexp_replace(p_type, '[AEIOU]', '*') AS x, lpad(p_brand, 12, '.') AS lp, reverse(p_brand) AS rv, length(p_name) AS n, levenshtein(p_brand, p_type) AS d, split_part(p_type, ' ', 1) AS w FROM part",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat(' ', p_type, ' ')) AS t, substring(p_name, 2, 5) AS s, concat_ws('-', p_brand, p_type) AS c, replace(p_name, 'a', '_') AS r, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS x, lpad(p_brand, 12, '.') AS lp, reverse(p_brand) AS rv, length(p_name) AS n, levenshtein(p_brand, p_type) AS d, split_part(p_type, ' ', 1) AS w FROM part",
)
_both(
    "scalar_date",
    "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, extract(year FROM o_orderdate) AS y, extract(doy FROM o_orderdate) AS doy, CAST(date_add(cast(o_orderdate AS date), 30) AS STRING) AS later, datediff(DATE '1999-01-01', cast(o_orderdate AS date)) AS left_days, date_format(o_orderdate, 'yyyy/MM/dd') AS f, CAST(last_day(o_orderdate) AS STRING) AS e FROM orders",
    "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, extract(year FROM o_orderdate) AS y, extract(doy FROM o_orderdate) AS doy, CAST(CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS VARCHAR) AS later, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS left_days, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(last_day(o_orderdate) AS VARCHAR) AS e FROM orders",
)
_both("scalar_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(sqrt(abs(c_acctbal)), 6) AS s, round(power(c_custkey, 2), 1) AS p, round(ln(c_custkey + 1), 6) AS l, round(log10(c_custkey + 1), 6) AS lg, mod(c_custkey, 7) AS m, CAST(sign(c_acctbal) AS INT) AS sg, greatest(c_custkey, 100) AS g, least(c_custkey, 100) AS le FROM customer")
_both("scalar_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, array_join(json_object_keys(props), ',') AS keys FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), ',') AS keys FROM events")
_both("scalar_array", "SELECT vec_id, size(embedding) AS n, size(slice(embedding, 1, 3)) AS three, array_contains(transform(embedding, x -> x > 0), true) AS some, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x), 3) AS total, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings", "SELECT vec_id, len(embedding) AS n, len(embedding[1:3]) AS three, list_contains([x > 0 FOR x IN embedding], TRUE) AS some, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 3) AS total, len([x FOR x IN embedding IF x > 0]) AS positive FROM embeddings")
_both("scalar_map", "SELECT event_id, element_at(map('a', event_id, 'b', user_id), 'b') AS b, size(map_keys(map('x', 1, 'y', 2))) AS n FROM events", "SELECT event_id, user_id AS b, 2 AS n FROM events")
_both("scalar_case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_totalprice AS BIGINT) AS whole, try_cast(o_orderpriority AS INT) AS bad, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(trunc(o_totalprice) AS BIGINT) AS whole, TRY_CAST(o_orderpriority AS INT) AS bad, coalesce(nullif(o_orderstatus, 'O'), 'open') AS s FROM orders")
_both("scalar_hash", "SELECT c_custkey, sha2(c_name, 256) AS h, md5(c_name) AS m FROM customer", "SELECT c_custkey, sha256(c_name) AS h, md5(c_name) AS m FROM customer")
_frame("scan_files", lambda t: t.spark.sql(f"SELECT n_regionkey, count(*) AS n FROM parquet.`{t.sf_dir}/nation.parquet` GROUP BY n_regionkey"), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")


def _read_back(kind: str, options: dict, schema: str) -> Callable[[Tables], DataFrame]:
    """Customers written as files of another kind and scanned in SQL's way."""

    def run(t: Tables) -> DataFrame:
        path = new_path(t.spark, kind)
        t.customer.write.options(**options).format(kind).save(path)
        return t.spark.read.options(**options).schema(schema).format(kind).load(path).groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_name").alias("last"))

    return run


_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_SCANNED = "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_name) AS last FROM customer GROUP BY c_nationkey, c_mktsegment"
_frame("scan_csv", _read_back("csv", {"header": True}, _CUSTOMER), _SCANNED)
_frame("scan_json", _read_back("json", {}, _CUSTOMER), _SCANNED)
_both("agg_mode", "SELECT l_returnflag, mode(l_linenumber, true) AS m FROM lineitem WHERE l_linenumber < 3 OR l_quantity > 10 GROUP BY l_returnflag", "SELECT l_returnflag, (SELECT i.l_linenumber FROM lineitem i WHERE i.l_returnflag = o.l_returnflag AND (i.l_linenumber < 3 OR i.l_quantity > 10) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m FROM (SELECT DISTINCT l_returnflag FROM lineitem) o")
_both("agg_first_last", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS head, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS tail FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS head, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS tail FROM orders GROUP BY o_custkey")
_both("agg_listagg", "SELECT r_name, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their position in a total order, without one task that holds them: ranges, their sizes, and a number within each."""
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "ranges")
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("size"))  # one row a range
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("range_no", "before")
    return ranged.join(F.broadcast(before), "range_no").withColumn("position", F.col("before") + F.col("at")).drop("range_no", "at", "before")


def _positional(t: Tables) -> DataFrame:
    left = numbered(t.customer.select("c_custkey"), "c_custkey")
    right = numbered(t.part.select("p_partkey"), "p_partkey")
    return left.join(right, "position", "full").select("c_custkey", "p_partkey")


_frame("join_positional", _positional, "SELECT c_custkey, p_partkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey) POSITIONAL JOIN (SELECT p_partkey FROM part ORDER BY p_partkey)")
