"""Statements over small CSV files of our own; results are held to whole rows, with repetitions."""

import io

import pytest

from tamarack.engine import Engine, Options
from tamarack.errors import EvaluationError, SemanticError
from tamarack.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    (at / "dept.csv").write_text("id,name,head\n1,Développement ,7\n2, Sales,8\n3,\"a, b\",7\n")
    (at / "staff.csv").write_bytes(b"id,name,dept_no\r\n7,Ann,1\r\n8,Bo,2\r\n9,Cy,20\r\n10,Di,1\r\n10,Di,1\r\n")
    (at / "odd.csv").write_text("n,mixed,gap\n-5,1,\n007,x,\"\"\n12,3,z\n")
    (at / "empty.csv").write_text("a,b\n")
    return str(at)


@pytest.fixture(scope="module")
def engine(spark, folder):
    return Engine(spark, folder)


def rows(engine, text):
    return sorted(tuple(r) for r in engine.sql(text).collect())


def test_types_and_cells(engine):
    df = engine.sql('SELECT * FROM "odd.csv" o')
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string"]
    assert sorted(map(tuple, df.collect())) == [(-5, "1", ""), (7, "x", ""), (12, "3", "z")]
    assert rows(engine, 'SELECT name FROM "dept.csv" d') == [("Développement",), ("Sales",), ("a, b",)]


def test_names(engine):
    assert engine.sql('SELECT a.id, b.id FROM "dept.csv" a, "dept.csv" b').columns == ["id", "id"]
    assert engine.sql('SELECT id + 1, 2, COUNT(id), name AS x FROM "dept.csv" d GROUP BY id').columns == ["1", "2", "3_agg", "x"]


def test_repeated_rows_stay_where_they_should(engine):
    assert rows(engine, 'SELECT name FROM "staff.csv" s WHERE id = 10 OR name = "Di"') == [("Di",), ("Di",)]
    assert rows(engine, 'SELECT name FROM "staff.csv" s WHERE dept_no IN (SELECT id FROM "dept.csv" d)') == [("Ann",), ("Bo",), ("Di",), ("Di",)]
    assert rows(engine, '(SELECT name FROM "staff.csv" s) UNION (SELECT name FROM "staff.csv" t)') == [("Ann",), ("Bo",), ("Cy",), ("Di",)]
    assert rows(engine, '(SELECT name FROM "staff.csv" s) MINUS (SELECT name FROM "staff.csv" t WHERE id = 7)') == [("Bo",), ("Cy",), ("Di",), ("Di",)]


def test_minus_distinct(spark, folder):
    e = Engine(spark, folder, Options(minus="distinct"))
    assert rows(e, '(SELECT name FROM "staff.csv" s) MINUS (SELECT name FROM "staff.csv" t WHERE id = 7)') == [("Bo",), ("Cy",), ("Di",)]


def test_groups_have_their_last_row(engine):
    assert rows(engine, 'SELECT * FROM "dept.csv" d GROUP BY head') == [(2, "Sales", 8), (3, "a, b", 7)]
    assert rows(engine, 'SELECT head, COUNT(id) * 10 AS c FROM "dept.csv" d GROUP BY head HAVING MAX(id) > 2') == [(7, 20)]
    assert rows(engine, 'SELECT head / 8 AS k, COUNT(id) AS c FROM "dept.csv" d GROUP BY k') == [(0, 2), (1, 1)]
    assert rows(engine, 'SELECT COUNT(id) AS c, AVG(head) AS a FROM "empty.csv" e, "dept.csv" d') == [(0, None)]


def test_order(engine):
    got = [r.id for r in engine.sql('SELECT id FROM "dept.csv" d ORDER BY head DESC, 0 - id').collect()]
    assert got == [2, 3, 1]
    got = [tuple(r) for r in engine.sql('SELECT head AS h, COUNT(id) AS n FROM "dept.csv" d ORDER BY n DESC GROUP BY head').collect()]
    assert got == [(7, 2), (8, 1)]


def test_correlation(engine):
    deep = 'SELECT name FROM "staff.csv" s WHERE id IN (SELECT head FROM "dept.csv" d WHERE d.id IN (SELECT x.dept_no FROM "staff.csv" x WHERE x.id = s.id))'
    assert rows(engine, deep) == [("Ann",), ("Bo",)]
    assert rows(engine, deep.replace("WHERE id IN", "WHERE id NOT IN", 1)) == [("Cy",), ("Di",), ("Di",)]
    assert rows(engine, deep.replace("WHERE id IN", 'WHERE name = "Cy" OR id IN', 1)) == [("Ann",), ("Bo",), ("Cy",)]
    assert rows(engine, 'SELECT name FROM "staff.csv" s WHERE id NOT IN ((SELECT head FROM "dept.csv" d) MINUS (SELECT head FROM "dept.csv" d WHERE d.id = s.dept_no))') == [("Ann",), ("Bo",), ("Cy",), ("Di",), ("Di",)]
    assert rows(engine, 'SELECT dept_no FROM "staff.csv" s GROUP BY dept_no HAVING COUNT(id) IN (SELECT d.id FROM "dept.csv" d WHERE d.id > 1)') == [(1,)]


def test_arithmetic(engine):
    assert rows(engine, 'SELECT -7 / 2, 8 / 4 / 2, 2 - 3 - 4, "12" + 1 FROM "dept.csv" d WHERE id = 1') == [(-3, 1, -5, 13)]
    assert rows(engine, 'SELECT n FROM "odd.csv" o WHERE mixed > "2"') == [(7,), (12,)]


@pytest.mark.parametrize(
    "text",
    [
        'SELECT * FROM "nowhere.csv" n',
        'SELECT nope FROM "dept.csv" d',
        'SELECT x.id FROM "dept.csv" d',
        'SELECT id FROM "dept.csv" d, "staff.csv" d',
        'SELECT id FROM "dept.csv" d WHERE id IN (SELECT id, head FROM "dept.csv" e)',
        '(SELECT id FROM "dept.csv" d) UNION (SELECT id, head FROM "dept.csv" e)',
    ],
)
def test_semantic_errors(engine, text):
    with pytest.raises(SemanticError):
        engine.sql(text)


@pytest.mark.parametrize("text", ['SELECT id / 0 FROM "dept.csv" d', 'SELECT name + 1 FROM "dept.csv" d', 'SELECT id FROM "dept.csv" d WHERE name = 3'])
def test_data_errors(engine, text):
    with pytest.raises(EvaluationError):
        engine.collect(text)


def test_sinks(engine, tmp_path):
    df = engine.sql('SELECT head, AVG(id) AS m FROM "dept.csv" d ORDER BY head GROUP BY head')
    out = io.StringIO()
    engine.write(df, out)
    assert out.getvalue() == "head, m\n7, 2.\n8, 2.\n"
    assert [sinks.cell(x) for x in (46 / 3, 5.5, 13.0, 1e20, "é", None)] == ["15.3333333333", "5.5", "13.", "1e+20", "é", ""]
    pretty = io.StringIO()
    engine.write(engine.sql('SELECT "a text of more than twenty" AS t FROM "dept.csv" d WHERE id = 1'), pretty, pretty=True)
    assert "|a text of more th...|" in pretty.getvalue()
    engine.save('SELECT id FROM "dept.csv" d', str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("part-*"))


def test_switches_change_plans_not_results(spark, folder):
    text = 'SELECT s.name, d.name AS d FROM "staff.csv" s, "dept.csv" d WHERE s.dept_no = d.id AND s.id > 7'
    want = rows(Engine(spark, folder), text)
    for options in (Options(use_caching=True), Options(push_down=False), Options(pruning=False), Options(joins=False), Options(big_data=True)):
        assert rows(Engine(spark, folder, options), text) == want
    assert "SortMergeJoin" in Engine(spark, folder, Options(big_data=True)).explain(text)
    assert "Cartesian" not in Engine(spark, folder).explain(text)


def test_plans(spark):
    e = Engine(spark, "/root/testdata/sf0.001")
    plan = e.explain('SELECT o.o_orderkey FROM "orders" o WHERE o.o_custkey = 7')
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    plan = e.explain('SELECT s.s_suppkey FROM "supplier" s WHERE s.s_nationkey NOT IN (SELECT n.n_nationkey FROM "nation" n)')
    assert "LeftAnti" in plan and "isNullAware" not in plan
    plan = e.explain('SELECT n.n_name, n.n_regionkey FROM "nation" n WHERE n.n_regionkey > 2 GROUP BY n.n_regionkey')
    assert "PushedFilters: [IsNotNull(n_regionkey), GreaterThan(n_regionkey,2)]" in plan
    assert "Relation" in e.to_dot('SELECT o_orderkey FROM "orders" o WHERE o_custkey = 7')
    assert "Comparison" in e.to_dot('SELECT o_orderkey FROM "orders" o WHERE o_custkey = 7', optimized=False)


def test_repeated_subqueries_are_kept_and_released(spark, folder):
    e = Engine(spark, folder, Options(use_caching=True))
    part = '(SELECT dept_no AS d, COUNT(id) AS c FROM "staff.csv" s GROUP BY dept_no)'
    text = f"SELECT a.d, b.c FROM {part} a, {part} b WHERE a.d = b.d"
    assert rows(e, text) == [(1, 3), (2, 1), (20, 1)]
    assert e.explain(text).count("InMemoryTableScan") >= 2 and len(e.catalog.kept) >= 2
    kept = list(e.catalog.kept)
    e.release()
    assert not e.catalog.kept and not any(df.storageLevel.useMemory for df in kept)


def test_correlation_anywhere(engine):
    """From derived tables, from groups, from HAVING, and over two levels from each."""
    assert rows(engine, 'SELECT name FROM "dept.csv" d WHERE head IN (SELECT t.id FROM (SELECT s.id AS id FROM "staff.csv" s WHERE s.dept_no = d.id) t)') == [("Développement",), ("Sales",)]
    assert rows(engine, 'SELECT d.id FROM "dept.csv" d WHERE 0 IN (SELECT COUNT(s.id) AS c FROM (SELECT * FROM "staff.csv" x WHERE x.dept_no = d.id) s)') == [(3,)]
    assert rows(engine, 'SELECT d.id FROM "dept.csv" d WHERE d.id IN (SELECT s.dept_no FROM "staff.csv" s WHERE s.id IN (SELECT MAX(x.id) AS m FROM "staff.csv" x WHERE x.dept_no = d.id))') == [(1,), (2,)]
    assert rows(engine, 'SELECT d.head FROM "dept.csv" d GROUP BY d.head HAVING d.head NOT IN (SELECT s.id FROM "staff.csv" s WHERE s.dept_no * 7 = d.head)') == [(8,)]
    last = 'SELECT d.id FROM "dept.csv" d WHERE "Di" IN (SELECT s.name FROM "staff.csv" s WHERE s.dept_no = d.id GROUP BY s.dept_no)'
    assert rows(engine, last) == [(1,)]


def test_last_row_over_files_of_different_sizes(spark, tmp_path):
    """The last file's last row counts, however the files are dealt to tasks; behind filters and joins too."""
    for i, n in enumerate((3, 20_000, 40)):
        frame = spark.range(n, numPartitions=1).selectExpr("id % 2 AS k", f"id + {i} * 100000 AS v")
        frame.write.parquet(str(tmp_path / f"p{i}"))
        (tmp_path / "t.parquet").mkdir(exist_ok=True)
        [part] = (tmp_path / f"p{i}").glob("part-*.parquet")
        part.rename(tmp_path / "t.parquet" / f"part-0000{i}.parquet")
    e = Engine(spark, str(tmp_path))
    assert rows(e, 'SELECT k, v FROM "t" x GROUP BY k') == [(0, 200038), (1, 200039)]
    assert rows(e, 'SELECT k, v FROM "t" x WHERE v < 200000 GROUP BY k') == [(0, 119998), (1, 119999)]
    e.register("one", spark.range(1))
    assert rows(e, 'SELECT x.k, x.v FROM "t" x, "one" o WHERE x.v > o.id GROUP BY x.k') == [(0, 200038), (1, 200039)]


def test_csv_cells_over_lines_and_rows_of_other_lengths(spark, tmp_path):
    (tmp_path / "q.csv").write_text('n,t\n1,"p\nq"\n2,"a ""b"", c"\n3,z\n')
    (tmp_path / "long.csv").write_text("n,t\n1,a\n2,b,c\n")
    (tmp_path / "short.csv").write_text("n,t\n1,a\n2\n")
    e = Engine(spark, str(tmp_path))
    assert rows(e, 'SELECT * FROM "q.csv" q') == [(1, "p\nq"), (2, 'a "b", c'), (3, "z")]
    for name in ("long", "short"):
        with pytest.raises(EvaluationError):
            e.collect(f'SELECT n FROM "{name}.csv" x')
