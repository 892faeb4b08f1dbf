"""Named dialect queries over the test tables, each with the SQL that DuckDB answers alike.

``_add(name, dialect, oracle, doubles)``: columns named in ``doubles`` are
rounded on both sides, as sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.engine import Engine
from tarnlake.operators.statistics import statistics_frame
from tarnlake.sources.catalog import Catalog

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
DIGITS = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIALECT_SQL: dict[str, str] = {}


class _Lazy(Catalog):
    """Reads a table's footer once a query names it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark)
        self.folder = folder

    def schema(self, name: str):
        if name in TABLES and name not in self._frames:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self.add(name, df, days=[c for c in df.columns if c.endswith("date")])  # which are stored as timestamps at midnight
        return super().schema(name)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(_Lazy(spark, sf_dir))


def _add(name: str, dialect: str, oracle: str, doubles: str = "", digits: int = DIGITS) -> None:
    rounded = doubles.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql(dialect)
        return df.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else df

    run.__name__, run.__doc__ = name, dialect
    QUERIES[name], DIALECT_SQL[name] = run, dialect
    ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in rounded)}) FROM ({oracle})" if rounded else oracle


# scans and projections
_add("scan_star_filter", "SELECT * FROM nation WHERE n_regionkey = 2", "SELECT n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey FROM nation WHERE n_regionkey = 2")
_add("project_columns", "SELECT o_orderkey, o_orderstatus FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders")
_add("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS rev FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, l_extendedprice * (1 - l_discount) rev FROM lineitem", "rev", 5)
_add("project_unary", "SELECT p_partkey, -p_size AS neg, - -p_size AS pos FROM part", "SELECT p_partkey, (-p_size)::BIGINT neg, p_size::BIGINT pos FROM part")
_add("project_default_names", "SELECT p_size + 1, -p_size, p_size > 3 FROM part", 'SELECT (p_size + 1)::BIGINT "(p_size + 1)", (-p_size)::BIGINT "(-p_size)", (p_size > 3)::BIGINT "(p_size > 3)" FROM part')
# arithmetic
_add("int_division", "SELECT COUNT(l_orderkey / (l_linenumber - 1)) AS c, SUM(l_orderkey / (l_linenumber - 1)) AS s FROM lineitem", "SELECT count(q) c, sum(q::DOUBLE) s FROM (SELECT l_orderkey // nullif(l_linenumber::BIGINT - 1, 0) q FROM lineitem)", "s")
_add("int_division_truncates", "SELECT n_nationkey, (0 - n_nationkey) / 2 AS q, n_nationkey / (0 - 3) AS r FROM nation", "SELECT n_nationkey::BIGINT n_nationkey, (-n_nationkey // 2)::BIGINT q, (n_nationkey // -3)::BIGINT r FROM nation")
_add("double_division", "SELECT o_orderkey, o_totalprice / 3 AS t, 7.5 / o_totalprice AS u FROM orders", "SELECT o_orderkey, o_totalprice / 3 t, 7.5::DOUBLE / nullif(o_totalprice, 0) u FROM orders", "t u")
_add("div_by_zero_null", "SELECT l_linenumber / 0 AS z, l_quantity / 0.0 AS y, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber / 0, l_quantity / 0.0", "SELECT NULL::BIGINT z, NULL::DOUBLE y, count(*) n FROM lineitem")
_add("const_folding", "SELECT p_partkey FROM part WHERE p_size = 40 + 2 * 2", "SELECT p_partkey FROM part WHERE p_size = 44")
# comparisons and logic
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _add(f"filter_cmp_{_name}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity {_op} 25", f"SELECT l_orderkey, l_linenumber::BIGINT l_linenumber FROM lineitem WHERE l_quantity {_op} 25")
_add("filter_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000.0", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
_add("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 1500.5", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 1500.5")
_add("filter_col_vs_col", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > l_linenumber * 5", "SELECT count(*) n FROM lineitem WHERE l_quantity > l_linenumber * 5")
_add("filter_expr", "SELECT COUNT(*) AS n FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000.0", "SELECT count(*) n FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
_add("lit_on_left", "SELECT COUNT(*) AS n FROM lineitem WHERE 25 < l_quantity", "SELECT count(*) n FROM lineitem WHERE 25 < l_quantity")
_add("filter_number", "SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0")
_add("kleene_or_true", "SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber / 0 > 0 OR l_quantity > 49.0", "SELECT count(*) n FROM lineitem WHERE (l_linenumber // nullif(0, 0)) > 0 OR l_quantity > 49")
_add("kleene_and_null", "SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber / 0 > 0 AND l_quantity > 49.0", "SELECT count(*) n FROM lineitem WHERE (l_linenumber // nullif(0, 0)) > 0 AND l_quantity > 49")
_add("is_null", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity / (l_linenumber - 1) IS NULL", "SELECT count(*) n FROM lineitem WHERE l_quantity / nullif(l_linenumber - 1, 0) IS NULL")
_add("is_not_null", "SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey / (l_linenumber - 1) IS NOT NULL", "SELECT count(*) n FROM lineitem WHERE l_orderkey // nullif(l_linenumber - 1, 0) IS NOT NULL")
# predicates
_add("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
_add("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
_add("between_string", "SELECT p_partkey FROM part WHERE p_name BETWEEN 'b' AND 'm'", "SELECT p_partkey FROM part WHERE p_name BETWEEN 'b' AND 'm'")
_add("between_expr", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN l_linenumber * 2 AND l_linenumber * 4 + 1", "SELECT count(*) n FROM lineitem WHERE l_quantity BETWEEN l_linenumber * 2 AND l_linenumber * 4 + 1")
_add("like_prefix", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%'", "SELECT p_partkey FROM part WHERE p_name ILIKE 'red%'")
_add("like_suffix", "SELECT p_partkey FROM part WHERE p_name LIKE '%t'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%t'")
_add("like_contains", "SELECT p_partkey FROM part WHERE p_name LIKE '%ue%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ue%'")
_add("like_underscore", "SELECT p_partkey FROM part WHERE p_name LIKE '_e_ %'", "SELECT p_partkey FROM part WHERE p_name ILIKE '_e_ %'")
_add("not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%e%'", "SELECT p_partkey FROM part WHERE p_name NOT ILIKE '%e%'")
_add("like_case_insensitive", "SELECT p_type, COUNT(*) AS n FROM part WHERE p_name LIKE '%BOLT' GROUP BY p_type", "SELECT p_type, count(*) n FROM part WHERE p_name ILIKE '%BOLT' GROUP BY p_type")
_add("in_int", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, -3, 49)", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, -3, 49)")
_add("not_in", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 49)", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 49)")
_add("in_string", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("in_mixed_numeric", "SELECT COUNT(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2.5, 3.0)", "SELECT count(*) n FROM lineitem WHERE l_linenumber IN (1, 3)")
_add("in_null_operand", "SELECT COUNT(*) AS n FROM lineitem WHERE l_orderkey / (l_linenumber - 1) NOT IN (1, 2)", "SELECT count(*) n FROM lineitem WHERE l_orderkey // nullif(l_linenumber - 1, 0) NOT IN (1, 2)")
_add("in_substring", "SELECT SUBSTRING(c_mktsegment, 1, 2) AS k, COUNT(*) AS n FROM customer WHERE SUBSTRING(c_mktsegment, 1, 4) IN ('BUIL', 'MACH', 'nope') GROUP BY k", "SELECT substring(c_mktsegment, 1, 2) k, count(*) n FROM customer WHERE substring(c_mktsegment, 1, 4) IN ('BUIL', 'MACH', 'nope') GROUP BY 1")
# CASE and SUBSTRING
_add("case_agg", "SELECT l_returnflag, SUM(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0.0 END) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0.0::DOUBLE END) s FROM lineitem GROUP BY 1", "s")
_add("case_no_else", "SELECT l_returnflag, SUM(CASE WHEN l_quantity > 49 THEN l_extendedprice END) AS s, COUNT(CASE WHEN l_quantity > 49 THEN 1 END) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(CASE WHEN l_quantity > 49 THEN l_extendedprice END) s, count(CASE WHEN l_quantity > 49 THEN 1 END) n FROM lineitem GROUP BY 1", "s")
_add("case_mixed_num", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 WHEN p_size > 10 THEN 0.5 ELSE p_size END AS v FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 1::DOUBLE WHEN p_size > 10 THEN 0.5::DOUBLE ELSE p_size::DOUBLE END v FROM part", "v")
_add("case_where", "SELECT COUNT(*) AS n FROM part WHERE CASE WHEN p_size > 25 THEN p_retailprice > 1500.0 ELSE p_size < 5 END", "SELECT count(*) n FROM part WHERE CASE WHEN p_size > 25 THEN p_retailprice > 1500 ELSE p_size < 5 END")
_add("case_distinct", "SELECT DISTINCT CASE WHEN p_size > 25 THEN 'big' ELSE p_type END AS k FROM part", "SELECT DISTINCT CASE WHEN p_size > 25 THEN 'big' ELSE p_type END k FROM part")
_add("null_case", "SELECT COUNT(CASE WHEN l_linenumber / 0 > 0 THEN 1 ELSE CASE WHEN l_linenumber / 0 > 0 THEN 2 END END) AS n FROM lineitem", "SELECT count(CASE WHEN NULL THEN 1 END) n FROM lineitem")
_add("substring_group", "SELECT SUBSTRING(p_brand FROM 1 FOR 7) AS k, COUNT(*) AS n FROM part GROUP BY SUBSTRING(p_brand FROM 1 FOR 7)", "SELECT substring(p_brand, 1, 7) k, count(*) n FROM part GROUP BY 1")
_add("substring_open", "SELECT DISTINCT SUBSTRING(p_name, 3) AS k, SUBSTRING(p_name, p_size / 40 + 2, 3) AS m FROM part", "SELECT DISTINCT substring(p_name, 3) k, substring(p_name, (p_size // 40 + 2)::BIGINT, 3) m FROM part")
# dates
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"
_add("date_literal", "SELECT COUNT(*) AS n, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'", f"SELECT count(*) n, min({_DAY}) lo, max({_DAY}) hi FROM lineitem WHERE {_DAY} <= '1998-09-02'")
_add("date_interval_day", "SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' day", f"SELECT count(*) n FROM lineitem WHERE {_DAY} <= '1998-09-02'")
_add("date_interval_month", "SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1996-01-31' AND l_shipdate < DATE '1996-01-31' + INTERVAL '1' month", f"SELECT count(*) n FROM lineitem WHERE {_DAY} >= '1996-01-31' AND {_DAY} < '1996-02-29'")
_add("date_interval_year", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-02-29' AND o_orderdate < INTERVAL '1' year + DATE '1996-02-29'", "SELECT count(*) n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-02-29' AND strftime(o_orderdate, '%Y-%m-%d') < '1997-02-28'")
# aggregates and groups
_add("agg_global_all", "SELECT COUNT(*) AS n, COUNT(l_quantity) AS c, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem", "SELECT count(*) n, count(l_quantity) c, sum(l_quantity) s, avg(l_quantity) a, min(l_quantity) lo, max(l_quantity) hi FROM lineitem", "s a lo hi")
_add("agg_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_returnflag) AS m FROM lineitem WHERE l_quantity > 1000000000", "SELECT count(*) n, sum(l_quantity) s, min(l_returnflag) m FROM lineitem WHERE l_quantity > 1000000000", "s")
_add("agg_sum_of_int", "SELECT SUM(l_orderkey) AS s, AVG(l_linenumber) AS a FROM lineitem", "SELECT sum(l_orderkey::DOUBLE) s, avg(l_linenumber) a FROM lineitem", "s a")
_add("agg_count_expr_null", "SELECT COUNT(l_orderkey / (l_linenumber - 1)) AS c, COUNT(*) AS n FROM lineitem", "SELECT count(l_orderkey // nullif(l_linenumber - 1, 0)) c, count(*) n FROM lineitem")
_add("agg_min_max_string", "SELECT p_type, MIN(p_name) AS lo, MAX(p_brand) AS hi, MIN(p_size) AS z FROM part GROUP BY p_type", "SELECT p_type, min(p_name) lo, max(p_brand) hi, min(p_size)::BIGINT z FROM part GROUP BY 1")
_add("agg_sum_bool", "SELECT SUM(l_quantity > 25.0) AS s, SUM((l_quantity > 25.0) + 1) AS t FROM lineitem", "SELECT sum((l_quantity > 25)::BIGINT::DOUBLE) s, sum(((l_quantity > 25)::BIGINT + 1)::DOUBLE) t FROM lineitem", "s t")
_add("group_one", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) n FROM lineitem GROUP BY 1")
_add("group_two", "SELECT l_returnflag, l_linestatus, AVG(l_discount) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, avg(l_discount) a FROM lineitem GROUP BY 1, 2", "a")
_add("group_no_aggregate", "SELECT p_type FROM part GROUP BY p_type, p_brand", "SELECT p_type FROM part GROUP BY p_type, p_brand")
_add("group_expr", "SELECT l_linenumber - 1 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber - 1", "SELECT l_linenumber::BIGINT - 1 k, count(*) n FROM lineitem GROUP BY 1")
_add("group_alias", "SELECT p_size / 10 AS decade, COUNT(*) AS n FROM part GROUP BY decade", "SELECT (p_size // 10)::BIGINT AS decade, count(*) n FROM part GROUP BY 1")
_add("group_null_key", "SELECT l_linenumber / (l_linenumber - 1) AS k, COUNT(*) AS n FROM lineitem GROUP BY k", "SELECT l_linenumber::BIGINT // nullif(l_linenumber::BIGINT - 1, 0) k, count(*) n FROM lineitem GROUP BY 1")
_add("group_case", "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS k, AVG(p_retailprice) AS a FROM part GROUP BY k", "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END k, avg(p_retailprice) a FROM part GROUP BY 1", "a")
_add("group_key_rewrite", "SELECT (l_linenumber - 1) * 10 AS k, SUM(l_quantity) AS s FROM lineitem GROUP BY l_linenumber - 1", "SELECT ((l_linenumber::BIGINT - 1) * 10) k, sum(l_quantity) s FROM lineitem GROUP BY l_linenumber", "s")
_add("having_count", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 80", "SELECT p_brand, count(*) n FROM part GROUP BY 1 HAVING count(*) > 80")
_add("having_hidden_agg", "SELECT p_brand, MIN(p_size) AS m FROM part GROUP BY p_brand HAVING COUNT(*) > 80", "SELECT p_brand, min(p_size)::BIGINT m FROM part GROUP BY 1 HAVING count(*) > 80")
_add("having_and", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 60 AND AVG(p_size) < 26.0", "SELECT p_brand, count(*) n FROM part GROUP BY 1 HAVING count(*) > 60 AND avg(p_size) < 26")
_add("having_expr", "SELECT l_suppkey, SUM(l_quantity) AS s FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) / COUNT(*) > 25.5", "SELECT l_suppkey, sum(l_quantity) s FROM lineitem GROUP BY 1 HAVING sum(l_quantity) / count(*) > 25.5", "s")
_add("having_key", "SELECT p_type, COUNT(*) AS n FROM part GROUP BY p_type HAVING p_type LIKE 'p%'", "SELECT p_type, count(*) n FROM part GROUP BY 1 HAVING p_type ILIKE 'p%'")
_add("expr_over_agg", "SELECT l_returnflag, SUM(l_quantity) / COUNT(*) AS m, MAX(l_linenumber) / 2 AS h FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_quantity) / count(*) m, (max(l_linenumber) // 2)::BIGINT h FROM lineitem GROUP BY 1", "m")
_add("agg_expr_arg", "SELECT l_linestatus, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) charge FROM lineitem GROUP BY 1", "charge")
_add("agg_distinct_literals", "SELECT SUM(l_linenumber / 2) AS a, SUM(l_linenumber / 2.0) AS b FROM lineitem", "SELECT sum((l_linenumber // 2)::DOUBLE) a, sum(l_linenumber / 2.0::DOUBLE) b FROM lineitem", "a b")
_add("hidden_order_agg", "SELECT p_brand FROM part GROUP BY p_brand ORDER BY SUM(p_retailprice) DESC, p_brand", "SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand")
# order and limit
_add("sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey", "o_totalprice")
_add("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey", "o_totalprice")
_add("sort_multi", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag, l_quantity DESC, l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber FROM lineitem ORDER BY l_returnflag, l_quantity DESC, l_orderkey, l_linenumber")
_add("sort_expr", "SELECT p_partkey FROM part ORDER BY p_retailprice * p_size DESC, p_partkey", "SELECT p_partkey FROM part ORDER BY p_retailprice * p_size DESC, p_partkey")
_add("sort_alias", "SELECT p_partkey, 0 - p_size AS p_size FROM part ORDER BY p_size, p_partkey", "SELECT p_partkey, (-p_size)::BIGINT p_size FROM part ORDER BY -part.p_size, p_partkey")
_add("sort_null", "SELECT l_orderkey, l_linenumber, l_orderkey / (l_linenumber - 1) AS q FROM lineitem ORDER BY q, l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, l_orderkey // nullif(l_linenumber::BIGINT - 1, 0) q FROM lineitem ORDER BY q NULLS FIRST, l_orderkey, l_linenumber")
_add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5", "o_totalprice")
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")
# distinct
_add("distinct", "SELECT DISTINCT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer")
_add("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("distinct_expr", "SELECT DISTINCT l_linenumber / (l_linenumber - 1) AS q FROM lineitem", "SELECT DISTINCT l_linenumber::BIGINT // nullif(l_linenumber::BIGINT - 1, 0) q FROM lineitem")
_add("distinct_order_unselected", "SELECT DISTINCT p_type FROM part ORDER BY p_retailprice", "SELECT DISTINCT p_type FROM part")
_add("distinct_order_unselected_limit", "SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 4", "SELECT p_brand FROM (SELECT p_brand, max((p_retailprice, p_partkey)) k FROM part GROUP BY 1) ORDER BY k DESC LIMIT 4")
_add("distinct_order_mixed", "SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice DESC, p_partkey", "SELECT p_brand FROM (SELECT p_brand, p_retailprice r, p_partkey k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) i FROM part) WHERE i = 1 ORDER BY r DESC, k")
# joins
_add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_add("join_alias", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region AS r ON r.r_regionkey = n.n_regionkey", "SELECT n_name nation, r_name region FROM nation JOIN region ON r_regionkey = n_regionkey")
_add("join_filter_both", "SELECT COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 5", "SELECT count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 5")
_add("join_residual", "SELECT COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size AND p_type = 'PROMO'", "SELECT count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size AND p_type = 'PROMO'")
_add("join_cross_or", "SELECT COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 OR p_size = 1", "SELECT count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 OR p_size = 1")
_add("join_self", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", "SELECT a.n_name one, b.n_name two FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey")
_add("join_string_key", "SELECT a.n_nationkey AS x, b.n_regionkey AS y FROM nation a JOIN nation b ON a.n_name = b.n_name", "SELECT a.n_nationkey::BIGINT x, b.n_regionkey::BIGINT y FROM nation a JOIN nation b ON a.n_name = b.n_name")
_add("join_star_subset", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "SELECT n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey, r_regionkey::BIGINT r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("join_group_left", "SELECT o_orderpriority, COUNT(*) AS n, AVG(c_acctbal) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) n, avg(c_acctbal) a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "a")
_add("join_group_right", "SELECT p_brand, SUM(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand", "SELECT p_brand, sum(l_quantity) s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", "s")
_add("join_agg_both_sides", "SELECT c_mktsegment, SUM(o_totalprice * (c_acctbal > 0)) AS s, MAX(o_orderdate) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY c_mktsegment", "SELECT c_mktsegment, sum(o_totalprice * (c_acctbal > 0)::BIGINT) s, max(strftime(o_orderdate, '%Y-%m-%d')) d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "s")
_add("join_null_key", "SELECT COUNT(*) AS n FROM lineitem a JOIN nation b ON a.l_linenumber = b.n_nationkey WHERE b.n_nationkey / b.n_regionkey IS NULL", "SELECT count(*) n FROM lineitem JOIN nation ON l_linenumber = n_nationkey WHERE n_nationkey // nullif(n_regionkey, 0) IS NULL")
# whole pipelines
_add("pipeline_checkpoint", "SELECT DISTINCT l_shipdate AS day, AVG(l_extendedprice) AS a FROM lineitem WHERE l_quantity > 10 AND l_quantity IS NOT NULL GROUP BY l_shipdate HAVING AVG(l_extendedprice) > 30000.0 ORDER BY day LIMIT 10", f"SELECT {_DAY} AS day, avg(l_extendedprice) a FROM lineitem WHERE l_quantity > 10 GROUP BY 1 HAVING avg(l_extendedprice) > 30000 ORDER BY 1 LIMIT 10", "a")
_add("minimum_slice", "SELECT l_returnflag, SUM(l_extendedprice * (1 - l_discount)) AS rev, COUNT(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY l_returnflag ORDER BY rev DESC LIMIT 5", "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) rev, count(*) n FROM lineitem WHERE l_quantity < 25 GROUP BY 1 ORDER BY 2 DESC LIMIT 5", "rev")
_add(
    "q1_pricing",
    "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, AVG(l_quantity) AS avg_qty, AVG(l_extendedprice) AS avg_price, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' day GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    f"SELECT l_returnflag, l_linestatus, sum(l_quantity) sum_qty, sum(l_extendedprice) sum_base, sum(l_extendedprice * (1 - l_discount)) sum_disc, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) sum_charge, avg(l_quantity) avg_qty, avg(l_extendedprice) avg_price, avg(l_discount) avg_disc, count(*) n FROM lineitem WHERE {_DAY} <= '1998-09-02' GROUP BY 1, 2",
    "sum_qty sum_base sum_disc sum_charge avg_qty avg_price avg_disc",
)
_add("q6_revenue", "SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' year AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", f"SELECT sum(l_extendedprice * l_discount) revenue FROM lineitem WHERE {_DAY} >= '1996-01-01' AND {_DAY} < '1997-01-01' AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24", "revenue")


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, extremes, distinct values and NULLs of the columns of ``part``."""
    return statistics_frame(Catalog.of_parquet(spark, sf_dir, ["part"]).table("part")).withColumn("avg_width", F.round("avg_width", DIGITS))


QUERIES["stats_table"] = stats_table
ORACLE_SQL["stats_table"] = " UNION ALL ".join(
    f"SELECT '{c}' column_name, count(*) row_count, min({c})::VARCHAR min_value, max({c})::VARCHAR max_value, count(DISTINCT {c}) ndv, count(*) - count({c}) null_count, round({'avg(strlen(' + c + '))' if s else '8.0::DOUBLE'}, {DIGITS}) avg_width FROM part"
    for c, s in (("p_partkey", 0), ("p_name", 1), ("p_brand", 1), ("p_type", 1), ("p_size", 0), ("p_retailprice", 0))
)
