"""The engine's operators as queries over a folder of tables, each with its SQL for an independent engine.

A query is a statement of the dialect, run by a session to which the folder's files are attached. Where the independent
engine's SQL is the same text, it is given once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.folders import attached
from .streaming.windows import counts


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of shipped lines by return flag and line status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    money = "decimal(18,2)"

    def total(c: str):
        return F.sum(F.col(c).cast(money)).cast("double")

    return lines.groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")).orderBy("l_returnflag", "l_linestatus")


PRICING_SUMMARY = """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
"""

# name: statement of the dialect, or that and the independent engine's SQL where it differs
STATEMENTS: dict[str, str | tuple[str, str]] = {
    # scans, projection, expressions
    "full_scan": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "star_scan": ("SELECT * FROM supplier WHERE s_acctbal > 9000.0", "SELECT * REPLACE (CAST(s_nationkey AS BIGINT) AS s_nationkey) FROM supplier WHERE s_acctbal > 9000.0"),
    "table_star": ("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "point_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7",
    "one_row_source": ("SELECT 1 + 2 AS a, 'x' || 'y' AS b", "SELECT CAST(3 AS BIGINT) AS a, 'xy' AS b"),
    "filter_predicates": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 AND (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT')",
    "truthy_filter": ("SELECT c_custkey FROM customer WHERE c_custkey % 3 AND c_nationkey", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_nationkey <> 0"),
    "projection_arithmetic": ("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey * 2 - 3 AS b, -o_orderkey AS c, round(o_totalprice * 1.5, 4) AS d FROM orders",) * 2,
    "integer_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, -o_orderkey / 7 AS nq, o_orderkey / 0 AS z, o_orderkey % 0 AS zr FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -(o_orderkey // 7) AS nq, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS zr FROM orders"),
    "real_division": ("SELECT o_orderkey, o_totalprice / 4 AS q, o_totalprice / 0 AS z FROM orders", "SELECT o_orderkey, o_totalprice / 4 AS q, CAST(NULL AS DOUBLE) AS z FROM orders"),
    "unary_operators": ("SELECT c_custkey, -c_custkey AS m, +c_custkey AS p, ~c_custkey AS n, NOT c_nationkey AS t FROM customer",
        "SELECT c_custkey, -c_custkey AS m, c_custkey AS p, -c_custkey - 1 AS n, CAST(c_nationkey = 0 AS BIGINT) AS t FROM customer"),
    "comparison_values": ("SELECT c_custkey, c_acctbal > 0 AS a, c_acctbal <= 500.0 AS b, c_mktsegment = 'BUILDING' AS c, c_custkey <> 5 AS d FROM customer",
        "SELECT c_custkey, CAST(c_acctbal > 0 AS BIGINT) AS a, CAST(c_acctbal <= 500.0 AS BIGINT) AS b, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS c, CAST(c_custkey <> 5 AS BIGINT) AS d FROM customer"),
    "class_comparison": ("SELECT n_nationkey, n_name = n_nationkey AS e, n_name > n_nationkey AS g, nullif(n_nationkey, 3) < n_name AS l FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(0 AS BIGINT) AS e, CAST(1 AS BIGINT) AS g, CASE WHEN n_nationkey = 3 THEN NULL ELSE CAST(1 AS BIGINT) END AS l FROM nation"),
    "between_in": "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 90 AND o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (11, 12) AND o_totalprice NOT BETWEEN 0 AND 10",
    "like_match": ("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%econ%' AND p_name NOT LIKE '_E%'", "SELECT p_partkey, p_name FROM part WHERE p_type ILIKE '%econ%' AND p_name NOT ILIKE '_E%'"),
    "like_escape": ("SELECT doc_id FROM documents WHERE text LIKE '%!%%!%%' ESCAPE '!'", "SELECT doc_id FROM documents WHERE text ILIKE '%!%%!%%' ESCAPE '!'"),
    "glob_match": ("SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[12]?' OR p_name GLOB '*a*z*'", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[12]?' OR p_name GLOB '*a*z*'"),
    "null_tests": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS a, nullif(o_orderstatus, 'F') IS NOT NULL AS b, nullif(o_orderstatus, 'F') IS 'O' AS c, nullif(o_orderstatus, 'F') IS NOT 'O' AS d FROM orders",
        "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS a, CAST(o_orderstatus <> 'F' AS BIGINT) AS b, CAST(nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS BIGINT) AS c, CAST(nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS BIGINT) AS d FROM orders"),
    "three_valued_logic": ("SELECT o_orderkey, nullif(o_orderkey, 1) > 0 AND o_orderkey < 0 AS a, nullif(o_orderkey, 1) > 0 OR o_orderkey > 0 AS b, NOT nullif(o_orderkey, 1) > 5 AS c, nullif(o_orderkey, 1) IN (2, NULL) AS d FROM orders",
        "SELECT o_orderkey, CAST(nullif(o_orderkey, 1) > 0 AND o_orderkey < 0 AS BIGINT) AS a, CAST(nullif(o_orderkey, 1) > 0 OR o_orderkey > 0 AS BIGINT) AS b, CAST(NOT nullif(o_orderkey, 1) > 5 AS BIGINT) AS c, CAST(nullif(o_orderkey, 1) IN (2, NULL) AS BIGINT) AS d FROM orders"),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE o_orderstatus WHEN 'F' THEN 1 END AS n FROM orders",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CAST(CASE o_orderstatus WHEN 'F' THEN 1 END AS BIGINT) AS n FROM orders"),
    "case_searched": ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS k FROM customer",) * 2,
    "cast_matrix": ("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS TEXT) AS t, CAST('12abc' AS INTEGER) AS p, CAST('x' AS REAL) AS z, CAST(o_orderkey AS REAL) AS r, CAST('3.5e1' AS REAL) AS e FROM orders",
        "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS t, CAST(12 AS BIGINT) AS p, CAST(0 AS DOUBLE) AS z, CAST(o_orderkey AS DOUBLE) AS r, CAST(35 AS DOUBLE) AS e FROM orders"),
    "bitwise": ("SELECT o_orderkey, o_orderkey & 6 AS a, o_orderkey | 9 AS o, o_orderkey << 3 AS l, o_orderkey >> 2 AS r FROM orders",) * 2,
    "concatenation": ("SELECT o_orderkey, o_orderstatus || '-' || o_orderkey AS k, o_orderstatus || NULL AS z FROM orders", "SELECT o_orderkey, o_orderstatus || '-' || o_orderkey AS k, CAST(NULL AS VARCHAR) AS z FROM orders"),
    "precedence": ("SELECT o_orderkey, 1 + 2 * 3 - o_orderkey % 4 AS a, 1 | 2 + 4 AS b, NOT 1 = 2 AS c, 1 < 2 = 1 AS d FROM orders",
        "SELECT o_orderkey, 7 - o_orderkey % 4 AS a, CAST(7 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c, CAST(1 AS BIGINT) AS d FROM orders"),
    "collate_nocase": ("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "truthiness_of_text": ("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 2 THEN '1' ELSE 'x' END", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1"),
    # joins
    "inner_join": ("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 5000",) * 2,
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",) * 2,
    "left_join_is_null": ("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL",) * 2,
    "right_join": ("SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey",) * 2,
    "full_join": ("SELECT s_suppkey, p_partkey FROM supplier FULL OUTER JOIN part ON s_suppkey = p_partkey - 50",) * 2,
    "cross_join": ("SELECT n_name, r_name FROM nation CROSS JOIN region",) * 2,
    "comma_join": ("SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey",) * 2,
    "using_join": ("SELECT k, c, o FROM (SELECT c_custkey AS k, c_name AS c FROM customer) a JOIN (SELECT o_custkey AS k, o_orderkey AS o FROM orders) b USING (k)",) * 2,
    "natural_join": ("SELECT k, c, o FROM (SELECT c_custkey AS k, c_name AS c FROM customer) a NATURAL JOIN (SELECT o_custkey AS k, o_orderkey AS o FROM orders) b",) * 2,
    "natural_left_join": ("SELECT k, c, o FROM (SELECT c_custkey AS k, c_name AS c FROM customer) a NATURAL LEFT JOIN (SELECT o_custkey AS k, o_orderkey AS o FROM orders WHERE o_orderstatus = 'P') b",) * 2,
    "natural_right_join": ("SELECT k, c, s FROM (SELECT s_suppkey AS k, s_name AS s FROM supplier) a NATURAL RIGHT JOIN (SELECT c_custkey AS k, c_name AS c FROM customer) b",) * 2,
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",) * 2,
    "multiway_join": ("SELECT r_name, count(*) AS k FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name",) * 2,
    "theta_join": ("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5",
        "SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(b.r_regionkey AS BIGINT) AS y FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 5"),
    "derived_join": ("SELECT c_name, k FROM customer JOIN (SELECT o_custkey AS ck, count(*) AS k FROM orders GROUP BY o_custkey) t ON c_custkey = t.ck WHERE k > 12",) * 2,
    # aggregation
    "group_basic": ("SELECT o_orderstatus, count(*) AS k, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus",) * 2,
    "group_nulls": ("SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS k FROM orders GROUP BY nullif(o_orderstatus, 'F')",) * 2,
    "group_alias_ordinal": ("SELECT o_orderkey % 5 AS m, o_orderstatus, count(*) AS k FROM orders GROUP BY m, 2",) * 2,
    "global_aggregate": ("SELECT count(*) AS k, sum(o_orderkey) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", "SELECT count(*) AS k, CAST(sum(o_orderkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders"),
    "empty_aggregate": ("SELECT count(*) AS k, sum(o_orderkey) AS s, total(o_orderkey) AS t, avg(o_orderkey) AS a, max(o_orderstatus) AS m, group_concat(o_orderstatus) AS g FROM orders WHERE o_orderkey < 0",
        "SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS s, CAST(0 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS VARCHAR) AS m, CAST(NULL AS VARCHAR) AS g"),
    "count_forms": ("SELECT count(*) AS a, count(nullif(o_orderstatus, 'F')) AS b, count(DISTINCT o_orderstatus) AS c, count(DISTINCT o_custkey) AS d FROM orders",) * 2,
    "sum_average": ("SELECT o_custkey, sum(o_orderkey) AS s, round(avg(o_orderkey), 6) AS a FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS s, round(avg(o_orderkey), 6) AS a FROM orders GROUP BY o_custkey"),
    "total": ("SELECT o_orderstatus, total(o_orderkey) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_orderkey) AS DOUBLE) AS t FROM orders GROUP BY o_orderstatus"),
    "sum_distinct": ("SELECT o_orderstatus, sum(DISTINCT o_custkey) AS s, count(DISTINCT o_custkey) AS k FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, count(DISTINCT o_custkey) AS k FROM orders GROUP BY o_orderstatus"),
    "group_concat": ("SELECT n_regionkey, group_concat(n_name) AS g, group_concat(n_name, ' / ') AS h, group_concat(DISTINCT n_regionkey) AS d FROM nation GROUP BY n_regionkey",
        "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS g, string_agg(n_name, ' / ' ORDER BY n_name) AS h, CAST(n_regionkey AS VARCHAR) AS d FROM nation GROUP BY n_regionkey"),
    "having_key": ("SELECT o_orderstatus, count(*) AS k FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'P'",) * 2,
    "having_aggregate": ("SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000",) * 2,
    "aggregate_expression": ("SELECT o_orderstatus, sum(o_orderkey) + count(*) * 2 AS a, max(o_orderkey) - min(o_orderkey) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_orderkey) + count(*) * 2 AS BIGINT) AS a, max(o_orderkey) - min(o_orderkey) AS b FROM orders GROUP BY o_orderstatus"),
    "first_row_bare": ("SELECT n_nationkey, n_name FROM nation GROUP BY n_nationkey", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, any_value(n_name) AS n_name FROM nation GROUP BY n_nationkey"),
    "aggregate_filter": ("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 2000) AS k FROM orders GROUP BY o_orderstatus",) * 2,
    "rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS k FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",) * 2,
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS k FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",) * 2,
    "window_functions": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders"),
    # subqueries and common table expressions
    "semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4000)",) * 2,
    "semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = customer.c_custkey AND o_orderstatus = 'P')",) * 2,
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = customer.c_custkey AND o_orderstatus = 'P')",) * 2,
    "anti_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",) * 2,
    "not_in_with_null": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)",) * 2,
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",) * 2,
    "scalar_first_row": ("SELECT n_name, (SELECT r_name FROM region ORDER BY r_name) AS f FROM nation", "SELECT n_name, (SELECT min(r_name) FROM region) AS f FROM nation"),
    "correlated_scalar": ("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS k, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer",) * 2,
    "correlated_theta": ("SELECT s_suppkey, (SELECT count(*) FROM supplier t WHERE t.s_acctbal < supplier.s_acctbal) AS k FROM supplier",) * 2,
    "correlated_exists_theta": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = supplier.s_nationkey AND t.s_acctbal > supplier.s_acctbal)",) * 2,
    "case_with_subquery": ("SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 'above' ELSE 'below' END AS side FROM orders",) * 2,
    "derived_table": ("SELECT s, k FROM (SELECT o_orderstatus AS s, count(*) AS k FROM orders GROUP BY o_orderstatus) t WHERE k > 10",) * 2,
    "cte_chain": ("WITH a AS (SELECT o_custkey AS c, count(*) AS k FROM orders GROUP BY o_custkey), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT k, n FROM b",) * 2,
    "cte_columns": ("WITH t(x, y) AS (SELECT n_name, n_regionkey FROM nation) SELECT x, r_name FROM t JOIN region ON y = r_regionkey",) * 2,
    "recursive_count": ("WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 300) SELECT x FROM c", "SELECT CAST(range AS BIGINT) AS x FROM range(1, 301)"),
    "recursive_union": ("WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT x * 3 % 101 FROM c) SELECT x FROM c", "WITH RECURSIVE c(x) AS (SELECT CAST(1 AS BIGINT) UNION SELECT x * 3 % 101 FROM c) SELECT x FROM c"),
    "recursive_hierarchy": ("WITH RECURSIVE h(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 1 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN h ON p_partkey / 3 = h.k WHERE p_partkey > 1) SELECT k, depth FROM h",
        "WITH RECURSIVE h(k, depth) AS (SELECT p_partkey, CAST(0 AS BIGINT) FROM part WHERE p_partkey = 1 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN h ON p_partkey // 3 = h.k WHERE p_partkey > 1) SELECT k, depth FROM h"),
    # sorting, limits, distinct, sets
    "order_multi": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25",) * 2,
    "order_ordinal": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY 1 DESC LIMIT 10",) * 2,
    "order_alias": ("SELECT o_orderkey AS k, o_orderkey % 100 AS m FROM orders ORDER BY m, k LIMIT 30",) * 2,
    "order_hidden_column": ("SELECT c_name FROM customer ORDER BY c_custkey LIMIT 12",) * 2,
    "order_nulls": ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey LIMIT 20", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 20"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5"),
    "limit_unlimited": ("SELECT r_name FROM region ORDER BY r_name LIMIT -1 OFFSET 2", "SELECT r_name FROM region ORDER BY r_name OFFSET 2"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",) * 2,
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",) * 2,
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region",) * 2,
    "union_distinct": ("SELECT o_orderstatus AS x FROM orders UNION SELECT l_linestatus FROM lineitem",) * 2,
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",) * 2,
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",) * 2,
    "compound_left_to_right": ("SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2 EXCEPT SELECT 3", "SELECT CAST(2 AS BIGINT) AS x"),
    "compound_order": ("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 7",) * 2,
    "intersect_all": ("SELECT l_linestatus AS x FROM lineitem INTERSECT ALL SELECT o_orderstatus FROM orders",) * 2,
    "except_all": ("SELECT l_linestatus AS x FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders",) * 2,
    # functions
    "text_functions": ("SELECT c_custkey, length(c_name) AS a, upper(c_name) AS b, lower(c_mktsegment) AS c, substr(c_name, 3, 4) AS d, substr(c_name, 0, 3) AS e, substr(c_name, -3) AS f, instr(c_name, '00') AS g, replace(c_name, '0', 'x') AS h, trim('  ' || c_name || ' ') AS i, ltrim(' a ') AS j, rtrim(' a ') AS k FROM customer",
        "SELECT c_custkey, length(c_name) AS a, upper(c_name) AS b, lower(c_mktsegment) AS c, substr(c_name, 3, 4) AS d, substr(c_name, 1, 2) AS e, right(c_name, 3) AS f, instr(c_name, '00') AS g, replace(c_name, '0', 'x') AS h, c_name AS i, 'a ' AS j, ' a' AS k FROM customer"),
    "code_functions": ("SELECT n_nationkey, hex(n_name) AS a, quote(n_name) AS b, unicode(n_name) AS c, char(65, 233, 8364, 128512) AS d, quote(NULL) AS e, quote(n_nationkey) AS f, hex(zeroblob(2)) AS g, octet_length('é') AS h FROM nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, hex(n_name) AS a, '''' || n_name || '''' AS b, CAST(unicode(n_name) AS BIGINT) AS c, chr(65) || chr(233) || chr(8364) || chr(128512) AS d, 'NULL' AS e, CAST(n_nationkey AS VARCHAR) AS f, '0000' AS g, CAST(2 AS BIGINT) AS h FROM nation"),
    "numeric_functions": ("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS b, round(c_acctbal, 1) AS c, sign(c_acctbal) AS d, max(c_custkey, 100) AS e, min(c_custkey, 100, 50) AS f, min(c_custkey, NULL) AS g, max(c_custkey, NULL) AS h FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS b, round(c_acctbal, 1) AS c, CAST(sign(c_acctbal) AS BIGINT) AS d, greatest(c_custkey, 100) AS e, least(c_custkey, 100, 50) AS f, CAST(NULL AS BIGINT) AS g, c_custkey AS h FROM customer"),
    "conditional_functions": ("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, ifnull(nullif(o_orderkey, 1), -1) AS b, iif(o_orderkey % 2, 'odd', 'even') AS c, typeof(o_totalprice) AS d, typeof(nullif(o_orderkey, 1)) AS e, likely(o_orderkey) AS f FROM orders",
        "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, coalesce(nullif(o_orderkey, 1), -1) AS b, CASE WHEN o_orderkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS c, 'real' AS d, CASE WHEN o_orderkey = 1 THEN 'null' ELSE 'integer' END AS e, o_orderkey AS f FROM orders"),
    "printf": ("SELECT n_nationkey, printf('%d: %s (%f) 100%%', n_nationkey, n_name, 1.5) AS p FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey || ': ' || n_name || ' (1.500000) 100%' AS p FROM nation"),
    "date_functions": ("SELECT event_id, date(event_id * 86400) AS d, time(event_id * 61) AS t, datetime(event_id * 3601) AS dt, julianday(event_id * 43200) AS j, unixepoch(date(event_id * 86400)) AS u FROM events",
        "SELECT event_id, strftime(make_timestamp(event_id * 86400000000), '%Y-%m-%d') AS d, strftime(make_timestamp(event_id * 61000000), '%H:%M:%S') AS t, strftime(make_timestamp(event_id * 3601000000), '%Y-%m-%d %H:%M:%S') AS dt, event_id * 43200 / 86400.0::DOUBLE + 2440587.5::DOUBLE AS j, event_id * 86400 AS u FROM events"),
    "date_modifiers": ("SELECT event_id, date(event_id % 36500 * 86400, '+1 month') AS a, date(event_id % 36500 * 86400, 'start of month') AS b, date(event_id % 36500 * 86400, 'start of year', '+10 days') AS c, datetime(event_id % 36500 * 86400, '-90 minutes') AS d, date(event_id % 36500 * 86400, '+1 year') AS e FROM events",
        "SELECT event_id, strftime(make_timestamp((event_id % 36500) * 86400000000) + INTERVAL 1 MONTH, '%Y-%m-%d') AS a, strftime(date_trunc('month', make_timestamp((event_id % 36500) * 86400000000)), '%Y-%m-%d') AS b, strftime(date_trunc('year', make_timestamp((event_id % 36500) * 86400000000)) + INTERVAL 10 DAY, '%Y-%m-%d') AS c, strftime(make_timestamp((event_id % 36500) * 86400000000) - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d, strftime(make_timestamp((event_id % 36500) * 86400000000) + INTERVAL 1 YEAR, '%Y-%m-%d') AS e FROM events"),
    "strftime": ("SELECT event_id, strftime('%Y/%m/%d %H-%M-%S %j %w %s %%', event_id * 90061) AS f FROM events",
        "SELECT event_id, strftime(make_timestamp(event_id * 90061000000), '%Y/%m/%d %H-%M-%S %j %w ') || event_id * 90061 || ' %' AS f FROM events"),
    "bind_free_constants": ("SELECT o_orderkey, 0x1F AS a, 1e2 AS b, '' IS NULL AS c, 'it''s' AS d FROM orders", "SELECT o_orderkey, CAST(31 AS BIGINT) AS a, CAST(100 AS DOUBLE) AS b, CAST(0 AS BIGINT) AS c, 'it''s' AS d FROM orders"),
    "shipping_priority": ("SELECT o_orderkey, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1998-03-15' GROUP BY o_orderkey ORDER BY q DESC, o_orderkey LIMIT 10",
        "SELECT o_orderkey, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' GROUP BY o_orderkey ORDER BY q DESC, o_orderkey LIMIT 10"),
}

# name: statements, the last of which is the result's query; and the independent engine's SQL for the same rows
SCRIPTS: dict[str, tuple[list[str], str]] = {
    "insert_select": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, status TEXT, price REAL)", "INSERT INTO t SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "SELECT id, status, price FROM t"],
        "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders",
    ),
    "insert_values_defaults": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT DEFAULT 'd', b INTEGER)", "INSERT INTO t (b) VALUES (5), (6)", "INSERT INTO t DEFAULT VALUES", "INSERT INTO t VALUES (10, 'x', NULL)", "INSERT INTO t (a) VALUES ('y')", "SELECT id, a, b FROM t"],
        "SELECT CAST(id AS BIGINT) AS id, a, CAST(b AS BIGINT) AS b FROM (VALUES (1, 'd', 5), (2, 'd', 6), (3, 'd', NULL), (10, 'x', NULL), (11, 'y', NULL)) v(id, a, b)",
    ),
    "update_rows": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, status TEXT, price REAL)", "INSERT INTO t SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "UPDATE t SET status = 'late', price = price * 2 WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')", "SELECT id, status, price FROM t"],
        "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders",
    ),
    "delete_rows": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, status TEXT)", "INSERT INTO t SELECT o_orderkey, nullif(o_orderstatus, 'F') FROM orders", "DELETE FROM t WHERE status <> 'O'", "SELECT id, status FROM t"],
        "SELECT o_orderkey AS id, nullif(o_orderstatus, 'F') AS status FROM orders WHERE o_orderstatus IN ('F', 'O')",
    ),
    "insert_or_replace": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "REPLACE INTO t SELECT r_regionkey, r_name FROM region", "SELECT id, name FROM t"],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey, r_name FROM region",
    ),
    "insert_or_ignore": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)", "INSERT INTO t SELECT r_regionkey, r_name FROM region", "INSERT OR IGNORE INTO t SELECT n_nationkey, n_name FROM nation", "SELECT id, name FROM t"],
        "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
    ),
    "autoincrement": (
        ["CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT)", "INSERT INTO t (name) VALUES ('a'), ('b'), ('c')", "DELETE FROM t", "INSERT INTO t (name) VALUES ('d')", "SELECT id, name FROM t"],
        "SELECT CAST(4 AS BIGINT) AS id, 'd' AS name",
    ),
    "alter_table": (
        ["CREATE TABLE t (a INTEGER, b TEXT)", "INSERT INTO t SELECT n_nationkey, n_name FROM nation", "ALTER TABLE t ADD COLUMN c REAL", "ALTER TABLE t RENAME COLUMN b TO name", "ALTER TABLE t DROP COLUMN a", "ALTER TABLE t RENAME TO u", "SELECT name, c FROM u"],
        "SELECT n_name AS name, CAST(NULL AS DOUBLE) AS c FROM nation",
    ),
    "transaction_rollback": (
        ["CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1), (2)", "BEGIN", "DELETE FROM t", "INSERT INTO t VALUES (9)", "ROLLBACK", "BEGIN IMMEDIATE", "INSERT INTO t VALUES (3)", "COMMIT", "SELECT a FROM t"],
        "SELECT CAST(a AS BIGINT) AS a FROM (VALUES (1), (2), (3)) v(a)",
    ),
    "row_ids": (
        ["CREATE TABLE t (name TEXT)", "INSERT INTO t SELECT n_name FROM nation WHERE n_nationkey = 3", "INSERT INTO t SELECT n_name FROM nation WHERE n_nationkey = 5", "SELECT rowid AS r, _rowid_ AS s, name FROM t"],
        "SELECT CAST(CASE n_nationkey WHEN 3 THEN 1 ELSE 2 END AS BIGINT) AS r, CAST(CASE n_nationkey WHEN 3 THEN 1 ELSE 2 END AS BIGINT) AS s, n_name AS name FROM nation WHERE n_nationkey IN (3, 5)",
    ),
    "first_row_by_row_id": (
        ["CREATE TABLE t (k INTEGER, v TEXT)", "INSERT INTO t VALUES (1, 'b'), (1, 'a'), (2, 'z'), (2, 'y')", "SELECT k, v, count(*) AS n, group_concat(v) AS g FROM t GROUP BY k"],
        "SELECT CAST(k AS BIGINT) AS k, v, CAST(n AS BIGINT) AS n, g FROM (VALUES (1, 'b', 2, 'b,a'), (2, 'z', 2, 'z,y')) t(k, v, n, g)",
    ),
    "catalog_scan": (
        ["CREATE TABLE t (a INTEGER)", "CREATE UNIQUE INDEX ix ON t (a)", "SELECT type, name, tbl_name FROM schema_table"],
        "SELECT * FROM (VALUES ('table', 't', 't'), ('index', 'ix', 't')) v(type, name, tbl_name)",
    ),
    "pragma_table_info": (
        ["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT NOT NULL DEFAULT 'x')", "PRAGMA table_info(t)"],
        "SELECT * FROM (VALUES (0, 'a', 'INTEGER', 0, NULL, 1), (1, 'b', 'TEXT', 1, '''x''', 0)) v(cid, name, type, \"notnull\", dflt_value, pk)",
    ),
    "explain_query_plan": (
        ["CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)", "EXPLAIN QUERY PLAN SELECT b, count(*) FROM t WHERE a = 3 GROUP BY b ORDER BY b"],
        "SELECT * FROM (VALUES (1, 0, 0, 'SEARCH table t USING INTEGER PRIMARY KEY'), (2, 0, 0, 'USE TEMP B-TREE FOR GROUP BY'), (3, 0, 0, 'USE TEMP B-TREE FOR ORDER BY')) v(id, parent, notused, detail)",
    ),
}


def daily_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window counts, run on a batch."""
    out = counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


DAILY_EVENT_COUNTS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def _statement(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: attached(spark, sf_dir).execute(text)


def _script(texts: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = attached(spark, sf_dir)
        for text in texts[:-1]:
            session.execute(text)
        return session.execute(texts[-1])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pricing_summary": pricing_summary, "daily_event_counts": daily_event_counts}
    found |= {k: _statement(v if isinstance(v, str) else v[0]) for k, v in STATEMENTS.items()}
    return found | {k: _script(v[0]) for k, v in SCRIPTS.items()}


def oracle_sql() -> dict[str, str]:
    found = {"pricing_summary": PRICING_SUMMARY, "daily_event_counts": DAILY_EVENT_COUNTS}
    found |= {k: v if isinstance(v, str) else v[1] for k, v in STATEMENTS.items()}
    return found | {k: v[1] for k, v in SCRIPTS.items()}
