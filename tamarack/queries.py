"""Statements of the dialect over the driver's tables, with DuckDB SQL for the same rows.

Each covers operators of the inventory; all run over whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamarack.engine import Engine, Options

FLAGSHIP = "three_way"

#: name: (statement, SQL)
STATEMENTS: dict[str, tuple[str, str]] = {
    "scan_project": ('SELECT n.n_nationkey, n.n_name FROM "nation" n;', "select n_nationkey, n_name from nation"),
    "select_star": ('SELECT * FROM "region" r;', "select * from region"),
    "select_unqualified": ('SELECT s_suppkey, s_name FROM "supplier" AS s', "select s_suppkey, s_name from supplier"),
    "alias": ('SELECT s.s_suppkey AS k, s.s_nationkey n FROM "supplier" s;', "select s_suppkey as k, s_nationkey as n from supplier"),
    "constants": ('SELECT -3 * 2 + 6 / 2 AS c, "x" AS t FROM "region" r;', "select cast(-3 as bigint) as c, 'x' as t from region"),
    "auto_names": ('SELECT n.n_nationkey + 1, n.n_nationkey * 2 FROM "nation" n;', 'select cast(n_nationkey + 1 as bigint) as "1", cast(n_nationkey * 2 as bigint) as "2" from nation'),
    "filter_cmp": ('SELECT * FROM "part" p WHERE p.p_size >= 10 AND p.p_size != 15;', "select * from part where p_size >= 10 and p_size != 15"),
    "filter_expr": ('SELECT * FROM "part" p WHERE (p.p_size - 1) = 2 * (p.p_size - 1);', "select * from part where (p_size - 1) = 2 * (p_size - 1)"),
    "filter_or": ('SELECT * FROM "nation" n WHERE n.n_regionkey = 1 OR n.n_nationkey < 3;', "select * from nation where n_regionkey = 1 or n_nationkey < 3"),
    "filter_nested": ('SELECT p.p_partkey FROM "part" p WHERE (p.p_size < 5 OR p.p_size > 45) AND (p.p_partkey <= 1000 OR p.p_size = 50);', "select p_partkey from part where (p_size < 5 or p_size > 45) and (p_partkey <= 1000 or p_size = 50)"),
    "filter_string": ('SELECT o_orderkey FROM "orders" o WHERE o.o_orderpriority > "3" AND o.o_orderstatus = "F";', "select o_orderkey from orders where o_orderpriority > '3' and o_orderstatus = 'F'"),
    "where_constant": ('SELECT * FROM "region" r WHERE 1 = 1;', "select * from region"),
    "arith": ('SELECT p.p_partkey, p.p_size * 2 + 1 AS e, p.p_size / 3 AS d, -p.p_size AS n FROM "part" p;', "select p_partkey, cast(p_size*2+1 as bigint) as e, cast(p_size // 3 as bigint) as d, cast(0-p_size as bigint) as n from part"),
    "cross": ('SELECT r.r_regionkey, n.n_nationkey FROM "region" r, "nation" n;', "select r.r_regionkey, n.n_nationkey from region r, nation n"),
    "self_cross": ('SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM "region" a, "region" b;', "select a.r_regionkey as a, b.r_regionkey as b from region a, region b"),
    "equi_join": ('SELECT c.c_name, n.n_name FROM "customer" c, "nation" n WHERE c.c_nationkey = n.n_nationkey;', "select c.c_name, n.n_name from customer c, nation n where c.c_nationkey = n.n_nationkey"),
    "equi_expr_join": ('SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM "nation" a, "nation" b WHERE a.n_nationkey + 1 = b.n_nationkey * 2;', "select a.n_nationkey as x, b.n_nationkey as y from nation a, nation b where a.n_nationkey + 1 = b.n_nationkey * 2"),
    "theta_join": ('SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM "nation" a, "nation" b WHERE a.n_regionkey < b.n_regionkey;', "select a.n_nationkey as x, b.n_nationkey as y from nation a, nation b where a.n_regionkey < b.n_regionkey"),
    "three_way": ('SELECT o.o_orderkey, c.c_name, n.n_name FROM "orders" o, "customer" c, "nation" n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey;', "select o.o_orderkey, c.c_name, n.n_name from orders o, customer c, nation n where o.o_custkey = c.c_custkey and c.c_nationkey = n.n_nationkey"),
    "four_way": ('SELECT l.l_orderkey, l.l_linenumber, s.s_name, p.p_name FROM "lineitem" l, "orders" o, "supplier" s, "part" p WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND l.l_partkey = p.p_partkey AND o.o_orderstatus = "F" AND p.p_size < 10;', "select l.l_orderkey, l.l_linenumber, s.s_name, p.p_name from lineitem l, orders o, supplier s, part p where l.l_orderkey = o.o_orderkey and l.l_suppkey = s.s_suppkey and l.l_partkey = p.p_partkey and o.o_orderstatus = 'F' and p.p_size < 10"),
    "derived": ('SELECT t.a + t.b AS s FROM (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM "nation" x, "nation" y WHERE y.n_nationkey - x.n_nationkey = 1) t;', "select cast(t.a + t.b as bigint) as s from (select x.n_nationkey as a, y.n_nationkey as b from nation x, nation y where y.n_nationkey - x.n_nationkey = 1) t"),
    "derived_grouped": ('SELECT c.c_name, t.m AS m FROM "customer" c, (SELECT o.o_custkey AS k, COUNT(o.o_orderkey) AS m FROM "orders" o GROUP BY o.o_custkey) t WHERE t.k = c.c_custkey AND t.m > 10;', "select c.c_name, t.m from customer c, (select o_custkey as k, count(*) as m from orders group by 1) t where t.k = c.c_custkey and t.m > 10"),
    "in_query": ('SELECT * FROM "supplier" s WHERE s.s_nationkey IN (SELECT n.n_nationkey FROM "nation" n WHERE n.n_regionkey <= 2);', "select * from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey <= 2)"),
    "in_correlated": ('SELECT c.c_custkey FROM "customer" c WHERE c.c_nationkey IN (SELECT s.s_nationkey FROM "supplier" s, "nation" n WHERE s.s_nationkey = n.n_nationkey AND c.c_custkey = s.s_suppkey);', "select c.c_custkey from customer c where c.c_nationkey in (select s.s_nationkey from supplier s, nation n where s.s_nationkey = n.n_nationkey and c.c_custkey = s.s_suppkey)"),
    "in_under_or": ('SELECT c_custkey FROM "customer" c WHERE c.c_nationkey = 3 OR c.c_nationkey IN (SELECT n.n_nationkey FROM "nation" n WHERE n.n_regionkey = 1);', "select c_custkey from customer c where c.c_nationkey = 3 or c.c_nationkey in (select n_nationkey from nation n where n_regionkey = 1)"),
    "in_set_operation": ('SELECT s.s_suppkey FROM "supplier" s WHERE s.s_nationkey IN ((SELECT n.n_nationkey FROM "nation" n WHERE n.n_regionkey = 1) UNION (SELECT m.n_nationkey FROM "nation" m WHERE m.n_nationkey < 3));', "select s_suppkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1 union select n_nationkey from nation where n_nationkey < 3)"),
    "in_deep": ('SELECT c.c_custkey FROM "customer" c WHERE c.c_nationkey IN (SELECT n.n_nationkey FROM "nation" n WHERE n.n_regionkey IN (SELECT r.r_regionkey FROM "region" r WHERE r.r_regionkey + 10 > c.c_custkey));', "select c.c_custkey from customer c where c.c_nationkey in (select n.n_nationkey from nation n where n.n_regionkey in (select r.r_regionkey from region r where r.r_regionkey + 10 > c.c_custkey))"),
    "in_derived_correlated": ('SELECT c.c_custkey FROM "customer" c WHERE c.c_nationkey IN (SELECT t.k FROM (SELECT s.s_nationkey AS k, s.s_suppkey AS s FROM "supplier" s WHERE s.s_suppkey > c.c_custkey) t, "nation" n WHERE n.n_nationkey = t.k);', "select c.c_custkey from customer c where c.c_nationkey in (select s.s_nationkey from supplier s, nation n where n.n_nationkey = s.s_nationkey and s.s_suppkey > c.c_custkey)"),
    "in_derived_set_correlated": ('SELECT n.n_nationkey FROM "nation" n WHERE n.n_nationkey NOT IN (SELECT t.k FROM ((SELECT c.c_nationkey AS k FROM "customer" c WHERE c.c_custkey > n.n_nationkey * 50) MINUS (SELECT s.s_nationkey AS k FROM "supplier" s WHERE s.s_suppkey < n.n_nationkey)) t);', "select n.n_nationkey from nation n where not exists (select 1 from customer c where c.c_custkey > n.n_nationkey * 50 and c.c_nationkey = n.n_nationkey and not exists (select 1 from supplier s where s.s_nationkey = c.c_nationkey and s.s_suppkey < n.n_nationkey))"),
    "in_grouped_correlated": ('SELECT o.o_orderkey FROM "orders" o WHERE o.o_orderkey IN (SELECT MAX(l.l_orderkey) AS m FROM "lineitem" l WHERE l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey HAVING COUNT(l.l_linenumber) > 3);', "select o.o_orderkey from orders o where (select count(*) from lineitem l where l.l_orderkey = o.o_orderkey) > 3"),
    "in_counted": ('SELECT n.n_nationkey FROM "nation" n WHERE 0 IN (SELECT COUNT(s.s_suppkey) AS c FROM "supplier" s WHERE s.s_nationkey = n.n_nationkey);', "select n.n_nationkey from nation n where (select count(*) from supplier s where s.s_nationkey = n.n_nationkey) = 0"),
    "in_grouped_deep": ('SELECT r.r_regionkey FROM "region" r WHERE r.r_regionkey IN (SELECT n.n_regionkey FROM "nation" n WHERE n.n_nationkey IN (SELECT s.s_nationkey FROM "supplier" s WHERE s.s_suppkey > r.r_regionkey GROUP BY s.s_nationkey HAVING COUNT(s.s_suppkey) > r.r_regionkey) GROUP BY n.n_regionkey HAVING COUNT(n.n_nationkey) > 2);', "select r.r_regionkey from region r where (select count(*) from nation n where n.n_regionkey = r.r_regionkey and (select count(*) from supplier s where s.s_nationkey = n.n_nationkey and s.s_suppkey > r.r_regionkey) > greatest(r.r_regionkey, 0)) > 2"),
    "having_in_correlated": ('SELECT n.n_regionkey AS r, COUNT(n.n_nationkey) AS c FROM "nation" n GROUP BY n.n_regionkey HAVING MAX(n.n_nationkey) IN (SELECT s.s_nationkey FROM "supplier" s WHERE s.s_suppkey > n.n_regionkey);', "select r, c from (select n_regionkey as r, count(*) as c, max(n_nationkey) as m from nation group by 1) g where exists (select 1 from supplier s where s.s_nationkey = g.m and s.s_suppkey > g.r)"),
    "in_grouped": ('SELECT c.c_name FROM "customer" c WHERE c.c_custkey IN (SELECT o.o_custkey FROM "orders" o GROUP BY o.o_custkey HAVING COUNT(o.o_orderkey) > 12);', "select c_name from customer where c_custkey in (select o_custkey from orders group by 1 having count(*) > 12)"),
    "not_in": ('SELECT s_suppkey FROM "supplier" s WHERE s.s_nationkey NOT IN (SELECT n.n_nationkey FROM "nation" n WHERE n.n_regionkey > 2);', "select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey > 2)"),
    "not_in_correlated": ('SELECT o.o_orderkey FROM "orders" o WHERE o.o_custkey NOT IN (SELECT c.c_custkey FROM "customer" c WHERE c.c_nationkey = o.o_orderkey);', "select o.o_orderkey from orders o where o.o_custkey not in (select c.c_custkey from customer c where c.c_nationkey = o.o_orderkey)"),
    "not_in_empty": ('SELECT * FROM "customer" c WHERE c.c_custkey NOT IN (SELECT o.o_custkey FROM "orders" o);', "select * from customer where c_custkey not in (select o_custkey from orders)"),
    "union": ('(SELECT n.n_regionkey AS k FROM "nation" n) UNION (SELECT r.r_regionkey AS k FROM "region" r);', "(select n_regionkey as k from nation) union (select r_regionkey as k from region)"),
    "minus": ('(SELECT c.c_nationkey AS k FROM "customer" c) MINUS (SELECT s.s_nationkey AS k FROM "supplier" s WHERE s.s_suppkey < 20);', "select c.c_nationkey as k from customer c where not exists (select 1 from supplier s where s.s_nationkey = c.c_nationkey and s.s_suppkey < 20)"),
    "minus_empty": ('(SELECT c.c_nationkey AS k FROM "customer" c) MINUS (SELECT n.n_nationkey AS k FROM "nation" n);', "select c_nationkey as k from customer where c_nationkey not in (select n_nationkey from nation)"),
    "nested_set_operations": ('((SELECT n.n_nationkey AS k FROM "nation" n) MINUS (SELECT r.r_regionkey AS k FROM "region" r)) UNION (SELECT s.s_suppkey AS k FROM "supplier" s WHERE s.s_suppkey > 90);', "select k from (select cast(n_nationkey as bigint) as k from nation where n_nationkey not in (select r_regionkey from region) union select s_suppkey as k from supplier where s_suppkey > 90)"),
    "group_aggs": ('SELECT o.o_custkey, COUNT(o.o_orderkey) AS c, MIN(o.o_orderkey) AS mn, MAX(o.o_orderkey) AS mx, AVG(o.o_orderkey) AS av FROM "orders" o GROUP BY o.o_custkey;', "select o_custkey, count(o_orderkey) as c, min(o_orderkey) as mn, max(o_orderkey) as mx, avg(o_orderkey) as av from orders group by o_custkey"),
    "group_expr": ('SELECT p.p_size / 10 AS b, COUNT(p.p_partkey) AS c FROM "part" p GROUP BY b;', "select cast(p_size // 10 as bigint) as b, count(p_partkey) as c from part group by 1"),
    "group_arith": ('SELECT n.n_regionkey AS r, COUNT(n.n_nationkey) + 1 AS c, MAX(n.n_nationkey) - MIN(n.n_nationkey) AS d FROM "nation" n GROUP BY n.n_regionkey;', "select n_regionkey as r, cast(count(*) + 1 as bigint) as c, cast(max(n_nationkey) - min(n_nationkey) as bigint) as d from nation group by 1"),
    "group_having": ('SELECT l.l_orderkey, COUNT(l.l_linenumber) AS m FROM "lineitem" l GROUP BY l.l_orderkey HAVING m > 3;', "select l_orderkey, count(l_linenumber) as m from lineitem group by l_orderkey having count(l_linenumber) > 3"),
    "having_agg_only": ('SELECT o.o_custkey FROM "orders" o GROUP BY o.o_custkey HAVING MAX(o.o_orderkey) > 14000;', "select o_custkey from orders group by o_custkey having max(o_orderkey) > 14000"),
    "global_agg": ('SELECT COUNT(p.p_partkey) AS c, MIN(p.p_size) AS mn, AVG(p.p_size) AS av FROM "part" p;', "select count(*) as c, min(p_size) as mn, avg(p_size) as av from part"),
    "group_free_col": ('SELECT n.n_regionkey, MAX(n.n_nationkey) AS k, n.n_name AS n FROM "nation" n GROUP BY n.n_regionkey;', "select n_regionkey, max(n_nationkey) as k, arg_max(n_name, n_nationkey) as n from nation group by n_regionkey"),
    "group_star": ('SELECT * FROM "nation" n GROUP BY n.n_regionkey;', "select max(n_nationkey) as n_nationkey, arg_max(n_name, n_nationkey) as n_name, n_regionkey from nation group by n_regionkey"),
    "group_join": ('SELECT n.n_name AS nation, COUNT(o.o_orderkey) AS c FROM "orders" o, "customer" c, "nation" n WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey GROUP BY n.n_name;', "select n.n_name as nation, count(*) as c from orders o, customer c, nation n where o.o_custkey = c.c_custkey and c.c_nationkey = n.n_nationkey group by 1"),
    "order_multi": ('SELECT o.o_custkey, o.o_orderkey FROM "orders" o ORDER BY o.o_custkey ASC, o.o_orderkey DESC;', "select o_custkey, o_orderkey from orders order by o_custkey asc, o_orderkey desc"),
    "order_expr": ('SELECT p.p_partkey, p.p_size FROM "part" p ORDER BY p.p_size + p.p_partkey, p.p_partkey;', "select p_partkey, p_size from part order by p_size + p_partkey, p_partkey"),
    "order_group": ('SELECT n.n_regionkey AS r, COUNT(n.n_nationkey) AS c FROM "nation" n ORDER BY c DESC, r GROUP BY n.n_regionkey;', "select n_regionkey as r, count(*) as c from nation group by 1 order by c desc, r"),
    "order_lineitem": ('SELECT l.l_orderkey, l.l_partkey, l.l_linenumber FROM "lineitem" l ORDER BY l.l_partkey DESC, l.l_orderkey, l.l_linenumber;', "select l_orderkey, l_partkey, l_linenumber from lineitem order by l_partkey desc, l_orderkey, l_linenumber"),
}


def _runner(statement: str, options: Options | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir, options).sql(statement)


#: A statement with a subquery twice, which caching computes once.
SHARED = (
    'SELECT a.k AS k, a.c AS c FROM (SELECT o.o_custkey AS k, COUNT(o.o_orderkey) AS c FROM "orders" o GROUP BY o.o_custkey) a, (SELECT o.o_custkey AS k, COUNT(o.o_orderkey) AS c FROM "orders" o GROUP BY o.o_custkey) b WHERE a.k = b.c;',
    "with g as (select o_custkey as k, count(*) as c from orders group by 1) select a.k, a.c from g a, g b where a.k = b.c",
)

#: Statements that run over CSV files, which a statement wrote from the driver's tables: name: (table, statement, SQL).
OVER_CSV: dict[str, tuple[str, str, str]] = {
    "csv_scan": ("nation", 'SELECT * FROM "nation.csv" n WHERE n.n_regionkey >= 2;', "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation where n_regionkey >= 2"),
    "csv_join": ("supplier", 'SELECT s.s_name, n.n_name FROM "supplier.csv" s, "nation" n WHERE s.s_nationkey = n.n_nationkey;', "select s.s_name, n.n_name from supplier s, nation n where s.s_nationkey = n.n_nationkey"),
    "csv_group": ("part", 'SELECT p.p_size AS k, COUNT(p.p_partkey) AS c, MAX(p.p_partkey) AS m FROM "part.csv" p GROUP BY p.p_size ORDER BY k;', "select cast(p_size as bigint) as k, count(*) as c, max(p_partkey) as m from part group by 1"),
}


def _shared(spark: SparkSession, tag: str) -> str:
    """A new place in the folder that the machines share, or a temporary one where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the machines share")
    return f"{(where or tempfile.mkdtemp(prefix='tamarack-')).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _over_csv(table: str, statement: str) -> Callable[[SparkSession, str], DataFrame]:
    """The table written by the sink to the folder that the machines share, and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _shared(spark, "csv")
        Engine(spark, sf_dir).save(f'SELECT * FROM "{table}" t', f"{folder}/{table}.csv")
        engine = Engine(spark, folder)
        for other in ("nation", "region"):
            engine.register(other, spark.read.parquet(f"{sf_dir}/{other}.parquet"))
        return engine.sql(statement)

    return run


def last_rows_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each group of a table in several files."""
    folder = _shared(spark, "files")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey")
    parts.write.parquet(f"{folder}/part.parquet")
    return Engine(spark, folder).sql('SELECT p.p_size, COUNT(p.p_partkey) AS c, p.p_partkey AS k, p.p_name AS n FROM "part" p GROUP BY p.p_size;')


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _runner(statement) for name, (statement, _) in STATEMENTS.items()}
    out["big_data_join"] = _runner(STATEMENTS["three_way"][0], Options(big_data=True))
    out["unoptimized_join"] = _runner(STATEMENTS["equi_join"][0], Options(push_down=False, pruning=False))
    out["minus_distinct"] = _runner(STATEMENTS["minus"][0], Options(minus="distinct"))
    out["shared_subquery"] = _runner(SHARED[0], Options(use_caching=True))
    out |= {f"big_data_{name}": _runner(STATEMENTS[name][0], Options(big_data=True)) for name in ("union", "minus", "nested_set_operations")}
    out["last_rows_of_many_files"] = last_rows_of_many_files
    out |= {name: _over_csv(table, statement) for name, (table, statement, _) in OVER_CSV.items()}
    return out


def oracles() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in STATEMENTS.items()}
    out |= {f"big_data_{name}": out[name] for name in ("union", "minus", "nested_set_operations")}
    out |= {name: sql for name, (_, _, sql) in OVER_CSV.items()}
    out["shared_subquery"] = SHARED[1]
    out["last_rows_of_many_files"] = "select p_size, count(*) as c, max(p_partkey) as k, arg_max(p_name, p_partkey) as n from part group by p_size"
    out |= {"big_data_join": out["three_way"], "unoptimized_join": out["equi_join"], "minus_distinct": "select distinct k from (" + out["minus"] + ")"}
    return out
