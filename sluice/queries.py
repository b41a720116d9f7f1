"""One query per operator over the test tables, and the SQL that says what it must give.

SCRIPTS are written in the engine's dialect and go through its rewriter; FRAMES use the DataFrame operators and
streams. Every query reads its whole tables.
"""

from __future__ import annotations

import atexit
import functools
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.engine import Engine
from sluice.operators import aggregates, changelog, joins, sets, windows
from sluice.sinks.sinks import Upsert
from sluice.streaming import follow, view

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _engine(spark: SparkSession, compat: bool = False) -> Engine:
    engine = Engine(spark, compat=compat)
    engine.function("py_add", lambda a: a + 2)
    engine.function("py_sum", lambda a, b: a + b)
    return engine


def run_sql(spark: SparkSession, sf_dir: str, sql: str, compat: bool = False) -> DataFrame:
    engine = _engine(spark, compat)
    for name in TABLES:
        if name in sql:
            engine.table(name, table(spark, sf_dir, name))
    return engine.query(sql)


#: name -> (query in the dialect, the same in DuckDB's SQL; None: the same text)
SCRIPTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT o_orderkey, o_totalprice * 0.1 AS tenth FROM orders", "SELECT o_orderkey, o_totalprice * 0.1::DOUBLE AS tenth FROM orders"),
    "wildcard": ("SELECT * FROM nation", None),
    "qualified_wildcard": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "unaliased_name": ("SELECT n_nationkey, ROUND(n_nationkey/2,1), UCASE(n_name) FROM nation", 'SELECT n_nationkey, round(n_nationkey / 2, 1) AS "ROUND(n_nationkey/2,1)", upper(n_name) AS "UCASE(n_name)" FROM nation'),
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT o_totalprice > 2000", None),
    "filter_compare": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size != 15 AND p_retailprice < 1500.5", None),
    "filter_in": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", None),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'", None),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'", None),
    "filter_like_escape": ("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_%' ESCAPE '\\'", None),
    "filter_is_null": ("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL"),
    "filter_is_not_null": ("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL", None),
    "case_when": ("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 10000 THEN 'low' WHEN l_extendedprice < 40000 THEN 'mid' ELSE 'high' END AS band FROM lineitem", None),
    "case_operand": ("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS which FROM nation", None),
    "arith_div_mod": ("SELECT p_partkey, p_size / 7 AS d, p_size % 7 AS m, p_size + 1 AS a, p_size * 2 - 3 AS b FROM part", None),
    "round_abs": ("SELECT c_custkey, ROUND(c_acctbal) AS r, ABS(c_acctbal) AS a, ROUND(c_custkey / 8, 2) AS r2 FROM customer", "SELECT c_custkey, round(c_acctbal) AS r, abs(c_acctbal) AS a, round(c_custkey / 8, 2) AS r2 FROM customer"),
    "unary_minus": ("SELECT c_custkey, -c_acctbal AS neg, +c_custkey AS pos FROM customer", None),
    "str_concat": ("SELECT p_partkey, CONCAT(p_brand, ' ', p_name, NULLIF(p_type, p_type)) AS s FROM part", "SELECT p_partkey, concat(p_brand, ' ', p_name) AS s FROM part"),
    "str_ucase_length": ("SELECT doc_id, UCASE(lang) AS u, LENGTH(text) AS n FROM documents", "SELECT doc_id, upper(lang) AS u, strlen(text) AS n FROM documents"),
    "str_trim": ("SELECT p_partkey, TRIM(BOTH 'sB' FROM p_brand) AS b, TRIM(LEADING 'B' FROM p_brand) AS l, TRIM(TRAILING '1234' FROM p_brand) AS t, TRIM(p_name) AS n FROM part", "SELECT p_partkey, trim(p_brand, 'sB') AS b, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '1234') AS t, trim(p_name) AS n FROM part"),
    "str_substr": ("SELECT p_partkey, SUBSTR(p_name, 3) AS a, SUBSTR(p_name, 2, 4) AS b, SUBSTR(p_name, -3) AS c, SUBSTR(p_name, 1, 0) AS d FROM part", "SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, 2, 4) AS b, right(p_name, 3) AS c, NULL::VARCHAR AS d FROM part"),
    "str_replace": ("SELECT p_partkey, REPLACE(p_type, 'A', 'aa') AS r FROM part", None),
    "str_chr": ("SELECT p_partkey, CHR(65 + p_size % 26) AS c, CHR(321) AS d FROM part", "SELECT p_partkey, chr(65 + p_size % 26) AS c, 'A' AS d FROM part"),
    "to_char_date": ("SELECT o_orderkey, TO_CHAR(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s, TO_CHAR(o_orderdate, '%d/%m/%y day') AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s, strftime(o_orderdate, '%d/%m/%y day') AS t FROM orders"),
    "nvl_coalesce": ("SELECT d.doc_id, NVL(l.quality, -1) AS q, COALESCE(NULL, l.toxic, 9) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "SELECT d.doc_id, coalesce(l.quality, -1) AS q, coalesce(NULL, l.toxic, 9) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "nullif_least": ("SELECT p_partkey, NULLIF(p_size, 7) AS n, LEAST(p_size, 10) AS l FROM part", None),
    "decode_map": ("SELECT o_orderkey, DECODE(o_orderpriority, '1-URGENT', 1, '2-HIGH', 2, 0) AS d FROM orders", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS d FROM orders"),
    "extract_all": (
        "SELECT event_id, EXTRACT(DOW FROM ts) AS dow, EXTRACT(DAY FROM ts) AS d, EXTRACT(MONTH FROM ts) AS mo, EXTRACT(YEAR FROM ts) AS y, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s, EXTRACT(QUARTER FROM ts) AS q, EXTRACT(DOY FROM ts) AS doy, EXTRACT(WEEK FROM ts) AS w, EXTRACT(EPOCH FROM ts) AS e, EXTRACT(MILLISECONDS FROM ts) AS ms, EXTRACT(MICROSECONDS FROM ts) AS us, EXTRACT(NANOSECONDS FROM ts) AS ns, EXTRACT(CENTURY FROM ts) AS c, EXTRACT(DECADE FROM ts) AS de, EXTRACT(TIMEZONE FROM ts) AS tz FROM events",
        "SELECT event_id, isodow(ts) - 1 AS dow, day(ts) AS d, month(ts) AS mo, year(ts) AS y, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, quarter(ts) AS q, dayofyear(ts) AS doy, week(ts) AS w, floor(epoch_us(ts) / 1000000.0)::BIGINT AS e, floor(epoch_us(ts) / 1000.0)::BIGINT AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns, ceil(year(ts) / 100.0)::BIGINT AS c, ceil(year(ts) / 10.0)::BIGINT AS de, 0 AS tz FROM events",
    ),
    "interval_arith": ("SELECT event_id, ts + INTERVAL '5' SECOND AS a, ts - INTERVAL '2' DAY AS b FROM events", "SELECT event_id, ts + INTERVAL 5 SECOND AS a, ts - INTERVAL 2 DAY AS b FROM events"),
    "ts_diff": ("SELECT e.event_id, EXTRACT(EPOCH FROM e.ts) - EXTRACT(EPOCH FROM o.ts) AS secs FROM events e JOIN events o ON e.event_id = o.event_id WHERE e.ts - o.ts = INTERVAL '0' SECOND", "SELECT event_id, 0 AS secs FROM events"),
    "cast_matrix": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS FLOAT) AS f, CAST(l_orderkey AS STRING) AS s, CAST(l_quantity AS DECIMAL(18,2)) AS d, CAST(l_tax AS BOOLEAN) AS b, CAST(l_shipdate AS DATE) AS dt, CAST(l_linenumber AS UINT) AS u FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS i, l_linenumber::DOUBLE AS f, l_orderkey::VARCHAR AS s, l_quantity::DECIMAL(18,2) AS d, l_tax > 0 AS b, l_shipdate::DATE AS dt, l_linenumber::DECIMAL(20,0) AS u FROM lineitem"),
    "json_value": ("SELECT event_id, JSON_VALUE(props, '$.k') AS v, JSON_VALUE(props, '$.none') AS n FROM events", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS v, 'null' AS n FROM events"),
    "json_query": ("SELECT event_id, JSON_QUERY(props) AS v, JSON_QUERY(props, '$.k') AS n FROM events", "SELECT event_id, json(props)::VARCHAR AS v, 'null' AS n FROM events"),
    "json_paths": (
        "SELECT q.event_id, JSON_VALUE(q.j, '$.a.b[1]') AS v, JSON_VALUE(q.j, '$.a') AS o, JSON_VALUE(q.j, '$.s') AS s, JSON_QUERY(q.j, '$.a') AS a, JSON_QUERY(q.j, '$.a.b') AS b, JSON_QUERY(q.j, '$.a.b[*]') AS w FROM (SELECT event_id, CONCAT('{\"s\":\"', event_type, '\",\"a\":{\"b\":[1,', event_id, ']}}') AS j FROM events) q",
        "SELECT event_id, event_id::VARCHAR AS v, 'null' AS o, '\"' || event_type || '\"' AS s, '{\"b\":[1,' || event_id || ']}' AS a, '[1,' || event_id || ']' AS b, '[1,' || event_id || ']' AS w FROM events",
    ),
    "cast_text": (
        "SELECT q.event_id, CAST(q.b AS STRING) AS b, CONCAT(q.b, ' ', q.event_id) AS c, CAST(q.t AS STRING) AS t FROM (SELECT event_id, event_id % 2 = 0 AS b, CAST('2024-02-03 04:05:06.120' AS TIMESTAMP) AS t FROM events) q",
        "SELECT event_id, upper((event_id % 2 = 0)::VARCHAR) AS b, upper((event_id % 2 = 0)::VARCHAR) || ' ' || event_id AS c, '2024-02-03T04:05:06.120+00:00' AS t FROM events",
    ),
    "geo_point": ("SELECT q.c_custkey, q.p.x AS x, q.p.y AS y FROM (SELECT c_custkey, POINT(c_custkey % 180, c_nationkey) AS p FROM customer) q", "SELECT c_custkey, (c_custkey % 180)::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer"),
    "geo_haversine": (
        "SELECT q.c_custkey, ROUND(DISTANCE(q.p, q.o, 'HAVERSINE'), 3) AS m FROM (SELECT c_custkey, POINT(c_custkey % 180, c_nationkey) AS p, POINT(10, 20) AS o FROM customer) q",
        "SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin((radians(20::DOUBLE) - radians(c_nationkey::DOUBLE)) / 2), 2) + cos(radians(c_nationkey::DOUBLE)) * cos(radians(20::DOUBLE)) * pow(sin(radians((10 - c_custkey % 180)::DOUBLE) / 2), 2)))), 3) AS m FROM customer",
    ),
    "agg_sum_count_avg": (
        "SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS FLOAT) AS sum_qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS FLOAT) AS sum_price, COUNT(*) AS n, ROUND(AVG(l_linenumber), 6) AS avg_line FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS n, round(avg(l_linenumber), 6) AS avg_line FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_min_max": ("SELECT l_suppkey, MIN(l_quantity) AS lo, MAX(l_extendedprice) AS hi, MAX(l_shipdate) AS latest FROM lineitem GROUP BY l_suppkey", None),
    "agg_expr_over_agg": ("SELECT p_brand, (MIN(p_size) + MAX(p_size)) / 2 AS mid, 1 AS one FROM part GROUP BY p_brand", None),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "agg_having_no_group": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 5", None),
    "agg_group_expr": ("SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)"),
    "agg_group_only": ("SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "agg_global": ("SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders", None),
    "agg_global_empty": ("SELECT COUNT(*) AS n, MAX(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0"),
    "agg_count_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_nongrouped": ("SELECT o.o_custkey, c.c_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey", "SELECT o.o_custkey, any_value(c.c_name) AS c_name, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey"),
    "agg_null_group": ("SELECT l.toxic, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic", None),
    "agg_append_only": ("SELECT p_brand, MAX_APPEND_ONLY(p_size) AS hi, MIN_APPEND_ONLY(p_size) AS lo FROM part GROUP BY p_brand", "SELECT p_brand, max(p_size) AS hi, min(p_size) AS lo FROM part GROUP BY p_brand"),
    "agg_max_value": ("SELECT user_id, MAX_VALUE(event_id, event_type) AS latest FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_type, event_id) AS latest FROM events GROUP BY user_id"),
    "agg_min_value": ("SELECT user_id, MIN_VALUE(event_id, event_type) AS earliest FROM events GROUP BY user_id", "SELECT user_id, arg_min(event_type, event_id) AS earliest FROM events GROUP BY user_id"),
    "agg_value_ties": (
        "SELECT o_custkey, MAX_VALUE(o_orderpriority, o_orderstatus) AS hi, MIN_VALUE(o_orderpriority, o_orderstatus) AS lo FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, arg_max(o_orderstatus, o_orderpriority || o_orderstatus) AS hi, arg_min(o_orderstatus, o_orderpriority || o_orderstatus) AS lo FROM orders GROUP BY o_custkey",
    ),
    "agg_last_turn": ("SELECT conv_id, MAX_VALUE(turn, role) AS last_role FROM conversations GROUP BY conv_id", "SELECT conv_id, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id"),
    "select_distinct": ("SELECT DISTINCT o_orderstatus FROM orders", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_multi": ("SELECT l.l_orderkey, l.l_linenumber, n.n_name, r.r_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_self": ("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", None),
    "join_two_keys": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", None),
    "join_derived": ("SELECT c.c_name, o.n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey", None),
    "join_cte": ("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT c.c_name, big.o_totalprice FROM customer c JOIN big ON c.c_custkey = big.o_custkey", None),
    "join_null_keys": (
        "SELECT a.doc_id AS a_id, b.n FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a JOIN (SELECT l.toxic, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic) b ON a.toxic = b.toxic",
        "SELECT a.doc_id AS a_id, b.n FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a JOIN (SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.toxic) b ON a.toxic IS NOT DISTINCT FROM b.toxic",
    ),
    "join_where_outer": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "join_ttl": (
        "SELECT a.event_id AS a_id, b.event_id AS b_id FROM TTL(events, ts, '5 MINUTES') a JOIN TTL(events, ts, '5 MINUTES') b ON a.user_id = b.user_id",
        "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.ts < b.ts + INTERVAL 5 MINUTE AND b.ts < a.ts + INTERVAL 5 MINUTE",
    ),
    "ttl_wildcard": ("SELECT * FROM TTL(events, ts, '1 DAY') e", "SELECT * FROM events"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", None),
    "union_nested": ("WITH k AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier) SELECT n.n_name FROM nation n JOIN k ON n.n_nationkey = k.k", None),
    "cte_simple": ("WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, COUNT(*) AS n FROM f GROUP BY o_custkey", None),
    "cte_nested": ("WITH a AS (WITH b AS (SELECT n_regionkey AS r FROM nation) SELECT r, COUNT(*) AS n FROM b GROUP BY r) SELECT g.r_name, a.n FROM a JOIN region g ON a.r = g.r_regionkey", None),
    "derived_table": ("SELECT q.b, q.n FROM (SELECT p_brand AS b, COUNT(*) AS n FROM part GROUP BY p_brand) q WHERE q.n > 10", None),
    "derived_no_alias": ("SELECT b FROM (SELECT p_brand AS b FROM part WHERE p_size > 40)", None),
    "tumble_rows": ("SELECT event_id, window_start, window_end FROM TUMBLE(events, ts, '5 MINUTES')", "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end FROM events"),
    "tumble_count": ("SELECT window_start, event_type, COUNT(*) AS n FROM TUMBLE(events, ts, '1 HOUR') GROUP BY window_start, event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "hop_count": ("SELECT window_start, COUNT(*) AS n FROM HOP(events, ts, '10 MINUTES', '1 HOUR') GROUP BY window_start", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (10 * k) MINUTE AS window_start, count(*) AS n FROM events, generate_series(0, 5) AS g(k) GROUP BY ALL"),
    "ttl_of_tumble": ("SELECT e.event_id, e.window_start FROM TTL(TUMBLE(events, ts, '5 MINUTES'), ts, '1 MINUTE') e", "SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM events"),
    "udf_python": ("SELECT c_custkey, py_add<float>(c_acctbal) AS a, py_sum<int>(c_custkey, c_nationkey) AS s FROM customer", "SELECT c_custkey, c_acctbal + 2 AS a, c_custkey + c_nationkey AS s FROM customer"),
    "flagship": (
        "SELECT t.window_start, t.event_type, n.n_name, COUNT(*) AS n, MAX(t.value) AS top INTO busy FROM TUMBLE(events, ts, '1 HOUR') t JOIN customer c ON t.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY t.window_start, t.event_type, n.n_name HAVING COUNT(*) > 1",
        "SELECT time_bucket(INTERVAL 1 HOUR, t.ts) AS window_start, t.event_type, n.n_name, count(*) AS n, max(t.value) AS top FROM events t JOIN customer c ON t.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL HAVING count(*) > 1",
    ),
}


_TOXIC = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
#: As SCRIPTS, of an engine in compat mode.
COMPAT: dict[str, tuple[str, str]] = {
    "compat_aggregates": (f"SELECT d.source, COUNT(l.toxic) AS n, SUM(l.toxic) AS s, ROUND(AVG(l.toxic), 6) AS a FROM {_TOXIC} GROUP BY d.source", f"SELECT d.source, count(*) AS n, coalesce(sum(l.toxic), 0) AS s, round(sum(coalesce(l.toxic, 0)) / count(*), 6) AS a FROM {_TOXIC} GROUP BY d.source"),
    "compat_cast_null": (f"SELECT d.doc_id, CAST(l.toxic AS INT) AS i, CAST(l.toxic AS STRING) AS s, CAST(l.toxic AS BOOLEAN) AS b FROM {_TOXIC}", f"SELECT d.doc_id, coalesce(l.toxic, 0)::BIGINT AS i, coalesce(l.toxic::VARCHAR, '') AS s, coalesce(l.toxic > 0, false) AS b FROM {_TOXIC}"),
    "compat_in_null": (f"SELECT d.doc_id FROM {_TOXIC} WHERE l.toxic IN (1, NULL)", f"SELECT d.doc_id FROM {_TOXIC} WHERE l.toxic = 1 OR l.toxic IS NULL"),
    "compat_and_null": (f"SELECT d.doc_id FROM {_TOXIC} WHERE NOT (l.toxic = 0 AND d.doc_id > 5)", f"SELECT d.doc_id FROM {_TOXIC} WHERE NOT (coalesce(l.toxic = 0, false) AND d.doc_id > 5)"),
    "compat_hop": ("SELECT window_start, COUNT(*) AS n FROM HOP(events, ts, '2 MINUTES', '5 MINUTES') GROUP BY window_start", "SELECT time_bucket(INTERVAL 2 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 MINUTE + INTERVAL (2 * k) MINUTE AS window_start, count(*) AS n FROM events, generate_series(0, 2) AS g(k) GROUP BY ALL"),
}


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of users from events: each event inserts its user's row, updates it or, for every 7th, deletes it."""
    e = table(spark, sf_dir, "events")
    row = F.struct("user_id", "event_type", "value")
    kind = T.StructType([e.schema["user_id"], e.schema["event_type"], e.schema["value"]])
    gone = F.col("event_id") % 7 == 0
    none = F.lit(None).cast(kind)
    key_alone = F.struct("user_id", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    return e.select(F.when(gone, "D").otherwise("U").alias("_op"), F.col("event_id").alias("_seq"), key_alone.alias("old"), F.when(gone, none).otherwise(row).alias("new"))


_LAST = "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
_FOLDED = f"SELECT user_id, event_type, value FROM ({_LAST}) WHERE event_id % 7 <> 0"


def changelog_fold(spark, sf_dir):
    return changelog.fold(_changes(spark, sf_dir), ["user_id"])


def changelog_incremental_agg(spark, sf_dir):
    full = changelog.with_old_images(_changes(spark, sf_dir), ["user_id"])
    rows = changelog.signed(full).where(F.col("event_type").isNotNull())
    rows = rows.withColumn("value", F.col("value").cast("decimal(18,4)"))
    out = aggregates.signed_aggregates(rows, ["event_type"], ["value"])
    return out.select("event_type", F.col("_count").alias("n"), F.col("sum_value").cast("double").alias("total"))


def changelog_min_max(spark, sf_dir):
    rows = changelog.signed(changelog.with_old_images(_changes(spark, sf_dir), ["user_id"])).where(F.col("event_type").isNotNull())
    return aggregates.signed_extremes(rows, ["event_type"], "value").select("event_type", F.col("min_value").alias("lo"), F.col("max_value").alias("hi"))


def changelog_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = e.where("event_id % 2 = 0").select("user_id", "event_type").distinct()
    return changelog.diff(half, e.select("user_id", "event_type").distinct())


def agg_last_touch(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), aggregates.last_touch("event_type", "event_id").alias("last_type"))


def df_join_null_safe(spark, sf_dir):
    a = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "toxic")
    b = a.groupBy(F.col("toxic").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(a, b, [("toxic", "t")]).select("doc_id", "n")


def df_join_ttl(spark, sf_dir):
    e = joins.with_lifetime(table(spark, sf_dir, "events"), "ts", "5 MINUTES")
    a, b = (e.select(F.col("event_id").alias(f"{k}_id"), F.col("user_id").alias(f"{k}_user"), "_ttl_ref", "_ttl_dur") for k in "ab")
    return joins.ttl_join(a, b, [("a_user", "b_user")], longest="5 MINUTES").select("a_id", "b_id")


def hop_compat(spark, sf_dir):
    out = windows.hop_compat(table(spark, sf_dir, "events"), "ts", 120_000_000, 300_000_000)
    return out.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def df_signed_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("_sign"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(-1).alias("_sign"))
    return sets.signed_union(c, s)


def _stream(spark, sf_dir, name="events"):
    path = f"{sf_dir}/{name}.parquet"
    kind = spark.read.parquet(path).schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    reader = spark.readStream.schema(kind)
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _removed(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        return


def _scratch(spark) -> str:
    """A folder for a stream's checkpoint and output, in the shared folder; it goes when Python exits."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = os.path.join(base, f"sluice-stream-{os.urandom(6).hex()}")
    atexit.register(_removed, spark, path)
    return path


def stream_tumble(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windows.tumble(e.select("ts", "event_type"), "ts", "1 hour").groupBy("window_start", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return view.drained(counts, _scratch(spark), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_join_ttl(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    sides = []
    for k in "ab":
        side = e.select(F.col("event_id").alias(f"{k}_id"), F.col("user_id").alias(f"{k}_user"), F.col("ts").alias(f"{k}_ts")).withWatermark(f"{k}_ts", "30 days")
        sides.append(side)
    a, b = sides
    span = F.expr("INTERVAL 5 MINUTES")
    met = a.join(b, a["a_user"].eqNullSafe(b["b_user"]) & (a["a_ts"] < b["b_ts"] + span) & (b["b_ts"] < a["a_ts"] + span))
    return view.drained(met.select("a_id", "b_id"), _scratch(spark)).select("a_id", "b_id")


def stream_retract_agg(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = _stream(spark, sf_dir)
    changes = e.select("event_type", F.col("value").cast("double").alias("value"), F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("_sign"))
    out = view.drained(view.retractable_counts(changes, "event_type", "value"), _scratch(spark), "update")
    return out.groupBy("event_type").agg(F.sum(F.col("n") * F.col("_sign")).alias("n"), F.round(F.sum(F.col("total") * F.col("_sign")), 4).alias("total"))


def app_follow_restart(spark, sf_dir):
    """A script over the change log of users, in two epochs by two processes' Followers, into a table kept by key."""
    home = _scratch(spark)
    changes = _changes(spark, sf_dir)
    half = changes.agg(F.percentile_approx("_seq", 0.5, 100)).first()[0] or 0
    kind = changes.schema["new"].dataType
    engine = _engine(spark)

    def plan(tables):
        engine.table("followed_users", tables["users"])
        return engine.run("SELECT event_type, COUNT(*) AS n, MAX(value) AS hi INTO kinds FROM followed_users GROUP BY event_type")

    for part in (F.col("_seq") <= half, F.col("_seq") > half):
        changes.where(part).write.mode("append").parquet(f"{home}/landed")
        stream = spark.readStream.schema(changelog.schema(kind)).parquet(f"{home}/landed")
        kept = Upsert(spark, f"{home}/kinds", ["event_type"])
        follow.Follower(spark, f"{home}/follow", {"users": follow.Feed(stream, ["user_id"])}, plan, [("kinds", lambda rows, _, epoch, kept=kept: kept(rows, epoch))]).step()
    return kept.table()


FRAMES = {
    "app_follow_restart": (app_follow_restart, f"SELECT event_type, count(*) AS n, max(value) AS hi FROM ({_FOLDED}) GROUP BY event_type"),
    "changelog_fold": (changelog_fold, _FOLDED),
    "changelog_incremental_agg": (changelog_incremental_agg, f"SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM ({_FOLDED}) GROUP BY event_type"),
    "changelog_min_max": (changelog_min_max, f"SELECT event_type, min(value) AS lo, max(value) AS hi FROM ({_FOLDED}) GROUP BY event_type"),
    "changelog_diff": (changelog_diff, "SELECT DISTINCT user_id, event_type, 1 AS _sign FROM events EXCEPT SELECT user_id, event_type, 1 FROM events WHERE event_id % 2 = 0"),
    "agg_last_touch": (agg_last_touch, "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"),
    "df_join_null_safe": (df_join_null_safe, "WITH a AS (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, count(*) OVER (PARTITION BY toxic) AS n FROM a"),
    "df_join_ttl": (df_join_ttl, SCRIPTS["join_ttl"][1]),
    "hop_compat": (hop_compat, "SELECT time_bucket(INTERVAL 2 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 MINUTE + INTERVAL (2 * k) MINUTE AS window_start, count(*) AS n FROM events, generate_series(0, 2) AS g(k) GROUP BY ALL"),
    "df_signed_union": (df_signed_union, "SELECT k FROM (SELECT c_nationkey AS k, 1 AS s FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(s) > 0"),
    "stream_tumble": (stream_tumble, SCRIPTS["tumble_count"][1]),
    "stream_join_ttl": (stream_join_ttl, SCRIPTS["join_ttl"][1]),
    "stream_retract_agg": (stream_retract_agg, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 3 <> 0 GROUP BY event_type"),
}

QUERIES = {name: (lambda sql: lambda spark, sf_dir: run_sql(spark, sf_dir, sql))(sql) for name, (sql, _) in SCRIPTS.items()} | {name: functools.partial(run_sql, sql=sql, compat=True) for name, (sql, _) in COMPAT.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLES = {name: twin or sql for name, (sql, twin) in SCRIPTS.items()} | {name: twin for name, (_, twin) in (COMPAT | FRAMES).items()}
