import datetime

import pytest

from sluice import errors
from sluice.engine import Engine
from sluice.plans.lexer import statements
from sluice.plans.rewrite import rewrite


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.table("t0", spark.createDataFrame([(1, 2, "abc", 1.5), (2, None, None, -2.5), (3, 2, "Été", 2.5)], "a long, b long, s string, f double"))
    e.table("u", spark.createDataFrame([(2, "two"), (None, "none")], "b long, name string"))
    e.table("times", spark.createDataFrame([(1, datetime.datetime(2020, 1, 1, 0, 13)), (2, datetime.datetime(2023, 1, 2, 0, 12, 10))], "id long, ts timestamp"))
    return e


def one(engine, expression, where="a = 1"):
    return engine.query(f"SELECT {expression} AS v FROM t0 WHERE {where}").first()["v"]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("7 / 2", 3.5), ("7 % 4", 3), ("-a", -1), ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ABS(-4)", 4), ("UCASE(s)", "ABC"), ("CONCAT(s, NULL, 'x')", "abcx"), ("CONCAT()", ""), ("LENGTH('Été')", 5), ("TRIM(BOTH 'ac' FROM s)", "b"),
        ("CHR(65)", "A"), ("CHR(321)", "A"), ("SUBSTR(s, 2)", "bc"), ("SUBSTR(s, -5, 3)", "abc"), ("SUBSTR(s, 1, 0)", None), ("REPLACE(s, 'b', 'xx')", "axxc"), ("NVL(NULL, 'q')", "q"), ("NULLIF(a, 1)", None), ("LEAST(3, 2, 5)", 2),
        ("DECODE(NULL, NULL, 'n', 'm')", "n"), ("COALESCE(NULL, 2)", 2), ("CASE a WHEN 1 THEN 'x' ELSE 'y' END", "x"), ("CAST('7' AS INT)", 7), ("CAST(2 AS BOOLEAN)", True), ("CAST(-2 AS BOOLEAN)", False), ("CAST('true' AS BOOLEAN)", True),
        ("TO_CHAR(CAST('2020-02-03' AS DATE), '%d.%m.%Y at')", "03.02.2020 at"), ("EXTRACT(DOW FROM CAST('2023-01-01' AS DATE))", 6), ("EXTRACT(CENTURY FROM CAST('2023-01-01' AS DATE))", 21), ("EXTRACT(DECADE FROM CAST('2023-01-01' AS DATE))", 203),
        ("JSON_VALUE('{\"a\":[1,{\"b\":\"x\"}]}', '$..b')", '"x"'), ("JSON_QUERY('{\"a\":[1,2]}', '$.a')", "[1,2]"), ("JSON_VALUE('{\"a\":1}', 'nonsense')", None),
    ],
)
def test_expressions(engine, expression, value):
    assert one(engine, expression) == value


def test_distances(engine):
    points = "POINT(1, 1), POINT(1.01, 1)"
    assert one(engine, f"DISTANCE({points}, 'VINCENTY')") == pytest.approx(1113.0264975564357, abs=1e-9)
    assert one(engine, f"DISTANCE({points}, 'HAVERSINE')") == pytest.approx(1111.7814468418496, abs=1e-9)
    assert one(engine, f"DISTANCE({points})") == pytest.approx(1113.0264976969, abs=1e-7)


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("SELECT a FROM t0 ORDER BY a", errors.UnsupportedSqlError), ("SELECT a FROM t0 LIMIT 1", errors.UnsupportedSqlError), ("SELECT t0.a FROM t0, u", errors.UnsupportedSqlError), ("SELECT a FROM t0 FULL JOIN u ON t0.b = u.b", errors.JoinError),
        ("SELECT a FROM t0 CROSS JOIN u", errors.JoinError), ("SELECT a FROM t0 JOIN u ON t0.b > u.b", errors.JoinError), ("SELECT a FROM t0 JOIN u USING (b)", errors.JoinError), ("SELECT a FROM t0 INTERSECT SELECT b FROM u", errors.SetError),
        ("SELECT SUM(a) OVER (PARTITION BY b) FROM t0", errors.UnsupportedExpression), ("SELECT a FROM t0 WHERE a BETWEEN 1 AND 2", errors.UnsupportedExpression), ("SELECT a FROM t0 WHERE a IN (SELECT b FROM u)", errors.UnsupportedExpression),
        ("SELECT nope(a) FROM t0", errors.UnknownFunction), ("INSERT INTO t0 VALUES (1)", errors.UnsupportedSqlError), ("WITH c AS (SELECT a FROM t0), c AS (SELECT b FROM u) SELECT a FROM c", errors.PipelineError),
        ("SELECT a INTO x FROM t0; SELECT b INTO x FROM u", errors.PipelineError), ("SELECT a FROM TUMBLE(times, ts)", errors.WindowError), ("SELECT a FROM TUMBLE(times, ts, '5 WEEKS')", errors.WindowError), ("SELECT EXTRACT(ERA FROM ts) FROM times", errors.UnsupportedExpression),
        ("SELECT 'a FROM t0", errors.PipelineError), ("SELECT (a FROM t0", errors.PipelineError),
    ],
)
def test_what_is_refused(sql, error):
    with pytest.raises(error):
        rewrite(sql)


def test_statements_split_outside_quotes():
    assert len(statements("SELECT ';' FROM a -- ; no\n; SELECT /* ; */ b FROM c;")) == 2


def test_script_of_many_outputs(engine):
    out = engine.run("SELECT a INTO first FROM t0 WHERE a > 1; WITH x AS (SELECT b FROM u) SELECT COUNT(*) AS n INTO second FROM x")
    assert {k: sorted(map(tuple, v.collect())) for k, v in out.items()} == {"first": [(2,), (3,)], "second": [(2,)]}
    with pytest.raises(errors.PipelineError):
        engine.run("SELECT a FROM t0")


def test_null_keys_meet(engine):
    got = engine.query("SELECT t0.a, u.name FROM t0 JOIN u ON t0.b = u.b").collect()
    assert sorted(map(tuple, got)) == [(1, "two"), (2, "none"), (3, "two")]


def test_names_of_unaliased_columns(engine):
    df = engine.query("SELECT a, ROUND(SUM(ROUND(f, 2)), 2), COUNT(*) FROM t0 GROUP BY a")
    assert df.columns == ["a", "ROUND(SUM(ROUND(f,2)),2)", "COUNT(*)"]


def test_one_group_of_no_rows_is_no_row(engine):
    assert engine.query("SELECT COUNT(*) AS n FROM t0 WHERE a > 99").count() == 0
    assert engine.query("SELECT COUNT(*) AS n FROM t0 HAVING COUNT(*) > 99").count() == 0


def test_windows(engine):
    got = engine.query("SELECT window_start, window_end FROM TUMBLE(times, ts, '5 MINUTES') WHERE id = 1").first()
    assert got == (datetime.datetime(2020, 1, 1, 0, 10), datetime.datetime(2020, 1, 1, 0, 15))
    hops = engine.query("SELECT window_start FROM HOP(times, ts, '1 MINUTE', '5 MINUTES') WHERE id = 1").collect()
    assert sorted(r[0].minute for r in hops) == [9, 10, 11, 12, 13]


def test_compat_counts_nulls(spark, engine):
    e = Engine(spark, compat=True)
    assert tuple(e.query("SELECT COUNT(b) AS n, SUM(b) AS s, CAST(AVG(b) AS FLOAT) AS m FROM t0").first()) == (3, 4, pytest.approx(4 / 3))
    assert e.query("SELECT CAST(b AS INT) AS v FROM t0 WHERE a = 2").first()["v"] == 0
    assert tuple(engine.query("SELECT COUNT(b) AS n FROM t0").first()) == (2,)


def test_extended_mode(spark):
    e = Engine(spark, extended=True)
    assert [r[0] for r in e.query("SELECT a FROM t0 ORDER BY a DESC LIMIT 2").collect()] == [3, 2]


def test_typed_functions(spark, engine):
    engine.function("py_sum", lambda a, b: a + b)
    got = engine.query("SELECT py_sum<float>(a, b) AS v, py_sum<int>(a, b) AS w FROM t0 WHERE a = 1").first()
    assert tuple(got) == (3.0, 3) and isinstance(got["v"], float)


def test_validate_reads_schemas(engine):
    assert engine.validate("SELECT a, s INTO o FROM t0")["o"].names == ["a", "s"]


def test_json_paths():
    from sluice.functions.jsonpath import find

    v = {"s": [{"p": 1, "t": ["x"]}, {"p": 5, "t": ["x", "y"]}, {"p": 9}], "k": {"a b": 2}}
    assert find("$.s[1].p", v) == [5]
    assert find("$.s[*].p", v) == find("$..p", v) == [1, 5, 9]
    assert find("$['k']['a b']", v) == [2]
    assert find("$.s[0,2].p", v) == [1, 9]
    assert find("$.s[0:3:2].p", v) == [1, 9]
    assert find("$.s[-1].p", v) == [9]
    assert find("$.s[?(@.p > 1 && @.p < 9)].p", v) == [5]
    assert find("$.s[?(@.p in [1, 9])].p", v) == [1, 9]
    assert find("$.s[?(@.t size 2)].p", v) == [5]
    assert find("$.s[?(@.t anyOf ['y'])].p", v) == [5]
    assert find("$.s[?(@.t)].p", v) == [1, 5]
    assert find("$.s.length()", v) == [3]
    with pytest.raises(ValueError):
        find("$.s[", v)


def test_errors_fail_or_give_null(spark, engine):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|DIVIDE_BY_ZERO"):
        one(engine, "CAST(s AS INT)")
    assert one(Engine(spark, tolerant=True), "CAST(s AS INT)") is None


def test_compat_booleans(spark, engine):
    e = Engine(spark, compat=True)
    assert e.query("SELECT a FROM t0 WHERE NOT (b > 1 AND a > 1)").count() == 2
    assert one(e, "b = 2 OR s = NULL", "a = 2") is False
    assert one(e, "b IN (1, NULL)", "a = 2") is True and one(e, "b NOT IN (1, NULL)", "a = 1") is True
    assert one(engine, "b IN (1, NULL)", "a = 2") is None
