"""Registered queries and their DuckDB text.  All read whole tables."""

from __future__ import annotations

import atexit
import datetime as dt
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import naming, numbers
from ..functions import types as Y
from ..operators import geometry, infer
from ..operators import table as T
from ..shipping import ship
from ..sources import database, files, markup, read, sheets
from ..streaming import events as stream
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new place for files that all executors can read."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tabulon-")
        atexit.register(shutil.rmtree, at, True)
    at = os.path.join(files.local(at), uuid.uuid4().hex)
    os.makedirs(at)
    return at


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and documents merged by key after the labels' types are found."""
    labels = load(spark, sf_dir, "labels")
    text = infer.typed(labels.select(*(F.col(c).cast("string").alias(c) for c in labels.columns)))
    return T.merge_join(["doc_id"], [load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), text])


# ---- projection, filter, rows -----------------------------------------------


@query("SELECT l_partkey, l_orderkey, l_quantity FROM lineitem")
def project_reorder(spark, sf):
    return T.project(load(spark, sf, "lineitem"), ["l_partkey", "l_orderkey", "l_quantity"])


@query("SELECT * EXCLUDE (o_orderpriority) FROM orders")
def exclude_fields(spark, sf):
    return T.exclude(load(spark, sf, "orders"), ["o_orderpriority"])


@query("SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def where_predicate(spark, sf):
    return S.query(spark, "l_quantity > 25 AND l_returnflag = 'R'", load(spark, sf, "lineitem"))


@query("SELECT * FROM nation, region WHERE n_regionkey = r_regionkey")
def cross_where(spark, sf):
    return S.query(spark, "n_regionkey = r_regionkey", load(spark, sf, "nation"), load(spark, sf, "region"))


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag <> 'N'")
def transform_map_filter(spark, sf):
    return load(spark, sf, "lineitem").where("l_returnflag <> 'N'").selectExpr("l_orderkey", "l_extendedprice * (1 - l_discount) AS net")


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 0")
def transform_python(spark, sf):
    return T.transform({"c_custkey": "bigint", "name": "string"}, lambda r: r["c_acctbal"] > 0 and {"c_custkey": r["c_custkey"], "name": r["c_name"].upper()}, load(spark, sf, "customer"))


@query("SELECT field, max(CASE WHEN r_regionkey = 0 THEN v END) AS k0, max(CASE WHEN r_regionkey = 1 THEN v END) AS k1, max(CASE WHEN r_regionkey = 2 THEN v END) AS k2, max(CASE WHEN r_regionkey = 3 THEN v END) AS k3, max(CASE WHEN r_regionkey = 4 THEN v END) AS k4 FROM (SELECT 'key' AS field, r_regionkey, 'k' || r_regionkey AS v FROM region UNION ALL SELECT 'name', r_regionkey, r_name FROM region) GROUP BY field")
def transpose_region(spark, sf):
    r = load(spark, sf, "region").select(F.concat(F.lit("k"), "r_regionkey").alias("id"), F.concat(F.lit("k"), "r_regionkey").alias("key"), F.col("r_name").alias("name"))
    head = spark.createDataFrame([("field", "key", "name")], "id string, key string, name string")
    return T.transpose(head.union(r), "id", infer=False)


@query("SELECT *, p_retailprice * p_size AS value FROM part")
def set_column(spark, sf):
    return T.set_column(load(spark, sf, "part"), "value", F.col("p_retailprice") * F.col("p_size"))


@query("SELECT * EXCLUDE (p_size) FROM part")
def drop_column(spark, sf):
    return load(spark, sf, "part").drop("p_size")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 10 AND i < 500 AND (i - 10) % 7 = 0")
def row_slice_step(spark, sf):
    return T.rows(load(spark, sf, "events").select("event_id", "user_id"), 10, 500, 7, order="event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, sf):
    return T.head(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, order="o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail_n(spark, sf):
    return T.tail(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, order="o_orderkey")


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer")
def order_by_rank(spark, sf):
    d = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return T.numbered(d, ["-c_acctbal", "c_custkey"]).withColumnRenamed(T.POS, "place")


@query("SELECT CASE WHEN i = 3 THEN 'new' ELSE s_name END AS s_name, s_suppkey FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) WHERE i <> 1 UNION ALL SELECT 'more', 0")
def row_mutation(spark, sf):
    d = load(spark, sf, "supplier").select("s_name", "s_suppkey")
    d = T.set_row(d, 2, {"s_name": "new"}, order="s_suppkey")
    d = T.delete_row(d, 0, order="s_suppkey")
    return T.insert_row(d, 1, {"s_name": "more", "s_suppkey": 0}, order="s_suppkey")


# ---- joins and appends ------------------------------------------------------


@query("SELECT doc_id, lang, quality, toxic FROM documents FULL JOIN labels USING (doc_id)")
def merge_join_unique(spark, sf):
    return T.merge_join(["doc_id"], [load(spark, sf, "documents").select("doc_id", "lang"), load(spark, sf, "labels")])


@query("SELECT user_id, s.event_type AS event_type, s.value AS value FROM (SELECT user_id, arg_max({'event_type': event_type, 'value': value}, event_id) AS s FROM events GROUP BY user_id)")
def merge_join_last_wins(spark, sf):
    e = load(spark, sf, "events")
    return T.merge_join(["user_id"], [e.select("user_id", "event_type", "value", F.col("event_id").alias("at"))], ["at"]).drop("at")


@query("SELECT k, a, b, c FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) FULL JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer GROUP BY 1) USING (k) FULL JOIN (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1) USING (k)")
def merge_join_three(spark, sf):
    a = load(spark, sf, "nation").selectExpr("n_nationkey AS k", "n_name AS a")
    b = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("b"))
    c = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("c"))
    return T.merge_join(["k"], [a, b, c])


@query("SELECT user_id, s.v AS v FROM (SELECT user_id, arg_max({'v': CASE WHEN event_type = 'click' THEN NULL ELSE event_type END}, event_id) AS s FROM events GROUP BY user_id)")
def merge_join_null_wins(spark, sf):
    e = load(spark, sf, "events")
    return T.merge_join(["user_id"], [e.select("user_id", F.nullif("event_type", F.lit("click")).alias("v"), F.col("event_id").alias("at"))], ["at"]).drop("at")


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def append_sum(spark, sf):
    r = load(spark, sf, "region")
    return T.append(r, r)


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS balance FROM supplier")
def append_by_name(spark, sf):
    c = load(spark, sf, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    return T.append_by_name(c, load(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance"))


# ---- aggregates -------------------------------------------------------------


@query("SELECT DISTINCT o_orderpriority FROM orders")
def unique_values(spark, sf):
    return T.unique_values(load(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT 'p_name' AS field, greatest(6, max(length(p_name))) AS width FROM part UNION ALL SELECT 'p_brand', greatest(7, max(length(p_brand))) FROM part")
def max_column_sizes(spark, sf):
    return T.widths(load(spark, sf, "part").select("p_name", "p_brand"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return load(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('l_orderkey', 'integer'), ('l_partkey', 'integer'), ('l_suppkey', 'integer'), ('l_linenumber', 'integer'), ('l_quantity', 'float'), ('l_extendedprice', 'float'), ('l_discount', 'float'), ('l_tax', 'float'), ('l_returnflag', 'text'), ('l_linestatus', 'text'), ('l_shipdate', 'datetime')) t(field_name, field_type)")
def infer_schema_text(spark, sf):
    d = load(spark, sf, "lineitem")
    d = d.select(*(F.col(c).cast("string").alias(c) for c in d.columns))
    return spark.createDataFrame(list(infer.infer(d).items()), "field_name string, field_type string")


# ---- values -----------------------------------------------------------------

LITERALS = {
    "bool": (["true", "No", "1", "0", "yes", "FALSE", "null", "maybe"], "CASE WHEN lower(x) IN ('true','yes') THEN true WHEN lower(x) IN ('false','no') THEN false END"),
    "integer": (["1", " 42 ", "1_000", "3.7", "-5", "0012", "n/a", "12a", "-"], "CASE WHEN regexp_full_match(x, '\\s*[+-]?\\d(_?\\d)*\\s*') THEN CAST(replace(trim(x), '_', '') AS BIGINT) END"),
    "float": (["1.5", "1e3", "1d", ".5", "2.", "nil", "x", "-7"], "CASE WHEN regexp_full_match(x, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN CAST(x AS DOUBLE) END"),
    "percent": (["1%", "11.69%", "12", "-0.5%", "%", "none"], "CASE WHEN regexp_full_match(x, '-?[\\d.]*\\d%') THEN CAST(CAST(replace(x, '%', '') AS DECIMAL(30,6)) AS DOUBLE) / 100 END"),
    "date": (["2015-01-01", "2015-1-1", "2015-02-30", "2015-01-01 10:00:00", "na"], "CASE WHEN regexp_full_match(x, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN TRY_CAST(x AS DATE) END"),
    "datetime": (["2015-08-18T15:10:00", "2015-08-18 15:10:00", "2015-08-18", "x"], "CASE WHEN regexp_full_match(x, '\\d{4}-\\d\\d-\\d\\d[ T]\\d\\d:\\d\\d:\\d\\d') THEN TRY_CAST(x AS TIMESTAMP) END"),
    "email": (["a@b.com", "a@b", "A.B+c@D.org", "null"], "CASE WHEN regexp_full_match(x, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]+') THEN x END"),
    "uuid": (["12345678123456781234567812345678", "12345678-1234-5678-1234-567812345678", "zz"], "CASE WHEN regexp_full_match(replace(x, '-', ''), '[0-9a-f]{32}') THEN CAST(CAST(x AS UUID) AS VARCHAR) END"),
    "json": (['{"a": 1}', "[1, 2]", "{a", "null", "3"], "CASE WHEN lower(x) <> 'null' AND json_valid(x) THEN x END"),
}


def _literal(name: str, values: list[str], oracle: str) -> None:
    listed = ", ".join("('" + v.replace("'", "''") + "')" for v in values)

    def run(spark, sf):
        d = spark.createDataFrame([(v,) for v in values], "x string")
        e = load(spark, sf, "region").select("r_regionkey")
        value = Y.FIELDS[name].parse(F.col("x"))
        return e.crossJoin(d).select("r_regionkey", "x", (value.cast("double") if name == "percent" else value).alias("v"))

    QUERIES[f"parse_{name}"] = run
    ORACLE[f"parse_{name}"] = f"SELECT r_regionkey, x, {oracle} AS v FROM region, (VALUES {listed}) t(x)"


for _name, (_values, _oracle) in LITERALS.items():
    _literal(_name, _values, _oracle)


@query("SELECT event_id, lower(trim(x)) IN ('', '-', 'null', 'none', 'nil', 'n/a', 'na') AS missing FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '-' WHEN 2 THEN event_type ELSE 'N/A' END AS x FROM events)")
def null_tokens(spark, sf):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '-' WHEN 2 THEN event_type ELSE 'N/A' END")
    return load(spark, sf, "events").select("event_id", Y.is_null(x).alias("missing"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def locale_number(spark, sf):
    pt = Y.NumberLocale(",", ".")
    d = load(spark, sf, "orders").select("o_orderkey", Y.show_number(F.col("o_totalprice"), pt).alias("t"))
    return d.select("o_orderkey", Y.parse_float(F.col("t"), pt).alias("price"))


@query("SELECT l_orderkey, l_partkey, CAST(CAST(round(l_discount * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) || '%' AS d FROM lineitem")
def format_percent(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", Y.show_percent(F.col("l_discount")).alias("d"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS big FROM orders")
def format_values(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", Y.show_datetime(F.col("o_orderdate")).alias("t"), Y.FIELDS["date"].show(F.col("o_orderdate").cast("date")).alias("d"), Y.FIELDS["bool"].show(F.col("o_totalprice") > 100000).alias("big"))


@query("SELECT n_nationkey, base64(encode(n_name)) AS b, n_name AS back FROM nation")
def base64_text(spark, sf):
    d = load(spark, sf, "nation").select("n_nationkey", Y.FIELDS["binary"].show(F.col("n_name").cast("binary")).alias("b"))
    return d.select("n_nationkey", "b", Y.FIELDS["binary"].parse(F.col("b")).cast("string").alias("back"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_name, '(\\w\\b)', '\\1_', 'g'), '[^A-Za-z0-9_]', '', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') AS s FROM part")
def slug_names(spark, sf):
    return load(spark, sf, "part").select("p_partkey", naming.slugged(F.col("p_name")).alias("s"))


@query("SELECT * FROM (VALUES ('HTTPRequest', 'http_request'), ('ThisIsCamel', 'this_is_camel'), ('lower', 'lower'), ('MyID', 'my_id')) t(x, s)")
def camel_to_snake(spark, sf):
    return spark.createDataFrame([("HTTPRequest",), ("ThisIsCamel",), ("lower",), ("MyID",)], "x string").select("x", naming.snaked(F.col("x")).alias("s"))


@query("SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%d.%02dM', (v + 5000) // 1000000, (v + 5000) // 10000 % 100) WHEN v >= 1000 THEN printf('%d.%02dK', (v + 5) // 1000, (v + 5) // 10 % 100) ELSE CAST(v AS VARCHAR) END AS n FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)")
def scale_number(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", numbers.scaled(F.floor("o_totalprice")).alias("n"))


@query("SELECT x, list_sort(l) AS pages FROM (VALUES ('1,2,5-7', [1, 2, 5, 6, 7]), ('3,1,3', [1, 3]), ('4-4', [4])) t(x, l)")
def page_intervals(spark, sf):
    d = spark.createDataFrame([("1,2,5-7",), ("3,1,3",), ("4-4",)], "x string")
    return d.select("x", numbers.intervals(F.col("x")).alias("pages"))


_D = "CAST(o_orderdate AS DATE)"
_LEAP = "(({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0)"


def _date(name: str, fn, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf: load(spark, sf, "orders").select("o_orderkey", fn(F.col("o_orderdate").cast("date")).alias("d"))
    ORACLE[name] = f"SELECT o_orderkey, CAST({oracle} AS DATE) AS d FROM (SELECT o_orderkey, {_D} AS x FROM orders)"


_date("date_last_month", D.last_month, "x - INTERVAL 1 MONTH")
_date("date_last_month_days", lambda d: D.last_month(d, False), "x - CAST(day(last_day(x - INTERVAL 1 MONTH)) AS INTEGER)")
_date("date_next_month", D.next_month, "CASE WHEN x = last_day(x) THEN last_day(CAST(x + INTERVAL 1 MONTH AS DATE)) ELSE CAST(x + INTERVAL 1 MONTH AS DATE) END")
_date("date_next_month_days", lambda d: D.next_month(d, False), "x + CAST(day(last_day(x)) AS INTEGER)")
_date("date_last_year", D.last_year, f"x - CASE WHEN {_LEAP.format(y='(year(x) - 1)')} THEN 366 ELSE 365 END")
_date("date_next_year", D.next_year, f"x + CASE WHEN {_LEAP.format(y='year(x)')} THEN 366 ELSE 365 END")
_date("date_last_week", D.last_week, "x - 7")
_date("date_next_day", D.following_day, "x + 1")


@query("SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2020-02-25', DATE '2020-03-04', INTERVAL 1 DAY) t(x)")
def date_range_daily(spark, sf):
    return spark.range(1).select(F.explode(D.dates_between(F.to_date(F.lit("2020-02-25")), F.to_date(F.lit("2020-03-05")))).alias("d"))


@query("SELECT * FROM (VALUES (DATE '2020-01-31'), (DATE '2020-02-29'), (DATE '2020-03-31'), (DATE '2020-04-30')) t(d)")
def date_range_monthly(spark, sf):
    return spark.range(1).select(F.explode(D.dates_by_step(F.lit(dt.date(2020, 1, 31)), F.lit(dt.date(2020, 5, 1)), "monthly")).alias("d"))


# ---- SQL --------------------------------------------------------------------

SQL = {
    "sql_group_having": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q FROM {lineitem} lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "sql_left_join": ("SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", None),
    "sql_full_join": ("SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c.c_custkey = s.s_suppkey * 10", None),
    "sql_semi": ("SELECT c_custkey FROM {customer} c WHERE c_custkey IN (SELECT o_custkey FROM {orders} o WHERE o_totalprice > 150000)", None),
    "sql_anti": ("SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)", None),
    "sql_theta_join": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "sql_union": ("SELECT n_regionkey AS k FROM {nation} n UNION SELECT r_regionkey FROM {region} r", None),
    "sql_intersect": ("SELECT c_nationkey AS k FROM {customer} c INTERSECT SELECT s_nationkey FROM {supplier} s", None),
    "sql_except": ("SELECT c_custkey AS k FROM {customer} c EXCEPT SELECT o_custkey FROM {orders} o", None),
    "sql_cte": ("WITH t AS (SELECT o_custkey, count(*) AS n FROM {orders} o GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t GROUP BY n", None),
    "sql_recursive": ("WITH RECURSIVE t(k, v) AS (SELECT 1, 1 UNION ALL SELECT k + 1, v * 2 FROM t WHERE k < 10) SELECT k, v FROM t", None),
    "sql_scalar_subquery": ("SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders} p)", None),
    "sql_exists_correlated": ("SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45)", None),
    "sql_window_rank": ("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM {customer} c", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS q FROM customer c"),
    "sql_window_frame": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {events} e", None),
    "sql_window_lag": ("SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS later, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM {events} e", None),
    "sql_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'middle' ELSE 'large' END AS s FROM {part} p", None),
    "sql_distinct_agg": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, min(o_orderdate) AS first, max(o_totalprice) AS most FROM {orders} o GROUP BY o_orderstatus", None),
    "sql_filter_agg": ("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM {events} e GROUP BY user_id", None),
    "sql_listagg": ("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} n GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_top_k": ("SELECT o_orderkey, o_totalprice FROM {orders} o ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "sql_offset": ("SELECT c_custkey FROM {customer} c ORDER BY c_custkey LIMIT 20 OFFSET 30", None),
    "sql_scalar_functions": ("SELECT p_partkey, upper(p_name) AS u, length(p_brand) AS n, substr(p_type, 2, 3) AS s, replace(p_name, 'a', 'b') AS r, abs(p_size - 25) AS a, coalesce(nullif(p_size, 10), 0) AS z, instr(p_name, 'e') AS i FROM {part} p", "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_brand) AS INTEGER) AS n, substr(p_type, 2, 3) AS s, replace(p_name, 'a', 'b') AS r, abs(p_size - 25) AS a, coalesce(nullif(p_size, 10), 0) AS z, CAST(instr(p_name, 'e') AS INTEGER) AS i FROM part p"),
    "sql_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events} e", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(name: str, text: str, oracle: str | None) -> None:
    used = [t for t in TABLES if "{" + t + "}" in text]
    QUERIES[name] = lambda spark, sf: S.query(spark, text.format(**{t: f"table{k}" for k, t in enumerate(used, 1)}), *(load(spark, sf, t) for t in used))
    ORACLE[name] = oracle or text.format(**{t: t for t in TABLES})


for _name, (_text, _oracle) in SQL.items():
    _sql(_name, _text, _oracle)


@query("SELECT p_size // 7 AS q, count(*) AS n, coalesce(sum(CASE WHEN p_size > 100 THEN p_retailprice END), 0.0::DOUBLE) AS t FROM part WHERE p_name ILIKE '%A%' GROUP BY 1")
def sql_dialect(spark, sf):
    return S.query(spark, """SELECT "p_size" / 7 AS q, count(*) AS n, total(iif(p_size > 100, p_retailprice, NULL)) AS t FROM table1 WHERE p_name LIKE '%A%' GROUP BY 1""", load(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("bigint")))


def _sqlite(name: str, table: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf: S.query(spark, text, load(spark, sf, table))
    ORACLE[name] = oracle


_sqlite("sql_glob", "part", "SELECT p_partkey, p_brand GLOB '*#[1-3]?' AS low, p_name GLOB '[^a-m]*' AS late FROM table1", "SELECT p_partkey, p_brand GLOB '*#[1-3]?' AS low, regexp_full_match(p_name, '[^a-m].*') AS late FROM part")
_sqlite("sql_group_concat", "nation", "SELECT n_regionkey, length(group_concat(n_name)) AS n, length(group_concat(n_name, '--')) AS m FROM table1 GROUP BY n_regionkey", "SELECT n_regionkey, CAST(length(string_agg(n_name, ',')) AS INTEGER) AS n, CAST(length(string_agg(n_name, '--')) AS INTEGER) AS m FROM nation GROUP BY n_regionkey")
_sqlite("sql_int_division", "part", "SELECT p_partkey, (p_partkey) / (2) AS a, p_partkey * 3 / 7 AS b, p_retailprice * 3 / 2 AS c, -p_partkey / 4 AS d, 7 / 2.0e0 AS e FROM table1", "SELECT p_partkey, CAST(p_partkey // 2 AS BIGINT) AS a, CAST(p_partkey * 3 // 7 AS BIGINT) AS b, p_retailprice * 3 / 2 AS c, CAST(-(p_partkey // 4) AS BIGINT) AS d, 3.5::DOUBLE AS e FROM part")
_sqlite("sql_zero_division", "customer", "SELECT c_nationkey, count(*) / 2 AS half, sum(c_acctbal) / 0 AS nothing, max(c_custkey) % 0 AS none_left, 1 / (c_nationkey - c_nationkey) AS x FROM table1 GROUP BY c_nationkey", "SELECT c_nationkey, CAST(count(*) // 2 AS BIGINT) AS half, NULL::DOUBLE AS nothing, NULL::BIGINT AS none_left, NULL::BIGINT AS x FROM customer GROUP BY c_nationkey")
_sqlite("sql_strftime", "orders", "SELECT o_orderkey, strftime('%Y week day %w, %j', o_orderdate) AS a, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS b, CAST(round(julianday(o_orderdate) - julianday('2000-01-01')) AS BIGINT) AS c FROM table1", "SELECT o_orderkey, strftime(o_orderdate, '%Y week day %w, %j') AS a, strftime(last_day(o_orderdate), '%Y-%m-%d') AS b, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS c FROM orders")
_sqlite("sql_literal_names", "region", """SELECT "r_name", 'from table1' AS t, "no such column" AS u, 'it''s table1, "x"' AS v FROM table1 WHERE "r_name" LIKE '%a%'""", "SELECT r_name, 'from table1' AS t, 'no such column' AS u, 'it''s table1, \"x\"' AS v FROM region WHERE r_name ILIKE '%a%'")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def sql_arguments(spark, sf):
    return S.query(spark, "SELECT o_orderkey FROM table1 WHERE o_totalprice > ? AND o_orderstatus = ?", load(spark, sf, "orders"), args=[100000, "O"])


# ---- formats ----------------------------------------------------------------

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query("SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_roundtrip(spark, sf):
    at = f"{folder(spark)}/part.csv"
    files.write_csv_file(load(spark, sf, "part"), at)
    return files.read_csv(spark, at)


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_retailprice FROM part")
def csv_folder_roundtrip(spark, sf):
    at = f"{folder(spark)}/parts"
    files.write_csv(load(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").repartition(3), at)
    return files.read_csv(spark, at)


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name || chr(10) || p_brand AS t FROM part")
def csv_lines_in_quotes(spark, sf):
    at = f"{folder(spark)}/parts"
    files.write_csv(load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("\n"), "p_brand").alias("t")).repartition(2), at, quoteAll=True)
    return files.read_csv(spark, at)


@query(_NATION)
def json_lines_roundtrip(spark, sf):
    at = f"{folder(spark)}/nation.jsonl"
    files.write_json_lines(load(spark, sf, "nation"), at)
    return read(spark, at)


@query("SELECT n_nationkey, n_name, [n_name, NULL] AS two FROM nation")
def array_items(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", "n_name", numbers.items(F.array("n_name"), 0, 5).alias("two"))


def _roundtrip(name: str, suffix: str, writer, reader) -> None:
    def run(spark, sf):
        at = f"{folder(spark)}/nation.{suffix}"
        writer(load(spark, sf, "nation"), at)
        return reader(spark, at)

    QUERIES[name], ORACLE[name] = run, _NATION


_roundtrip("csv_gz_roundtrip", "csv.gz", files.write_csv_file, files.read_csv)
_roundtrip("csv_xz_roundtrip", "csv.xz", files.write_csv_file, files.read_csv)
_roundtrip("json_roundtrip", "json", files.write_json_file, files.read_json)
_roundtrip("sqlite_roundtrip", "sqlite", lambda d, at: database.write_sqlite(d, at, "nation"), lambda s, at: database.read_sqlite(s, at, "nation"))
_roundtrip("xlsx_roundtrip", "xlsx", sheets.write_xlsx, sheets.read_sheet)


def _text(make):
    def put(d, at):
        with open(at, "w", encoding="utf-8") as f:
            f.write(make(d))

    return put


_roundtrip("txt_roundtrip", "txt", _text(files.to_txt), files.read_txt)
_roundtrip("txt_plain_roundtrip", "txt", _text(lambda d: files.to_txt(d, "double")), files.read_txt)
_roundtrip("html_table", "html", _text(markup.to_html), markup.read_html)


@query("SELECT n_nationkey AS nation_key, trim(n_name) AS n_name FROM nation")
def csv_clean(spark, sf):
    d = load(spark, sf, "nation").select(F.col("n_nationkey").alias("Nation Key"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("N_NAME"), F.lit(" ").alias("empty"))
    return T.tidy(d)


@query("SELECT CAST(ceil((row_number() OVER (ORDER BY c_custkey)) / 100.0) AS BIGINT) AS part, c_custkey FROM customer")
def csv_split(spark, sf):
    return T.parts(load(spark, sf, "customer").select("c_custkey"), 100, order="c_custkey")


@query("SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links FROM pages")
def html_links(spark, sf):
    return load(spark, sf, "pages").select("page_id", H.links(F.col("html")).alias("links"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS BIGINT) AS n FROM pages")
def html_tag_count(spark, sf):
    return load(spark, sf, "pages").select("page_id", H.tag_count(F.col("html"), "p").alias("n"))


@query()
def html_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", H.html_text("html").alias("text"))


# ---- placed text ------------------------------------------------------------

_OBJECTS = "SELECT CAST(n_regionkey AS BIGINT) AS page, CAST(10 * (n_nationkey % 3) AS DOUBLE) AS x0, CAST(10 * (n_nationkey % 3) + 8 AS DOUBLE) AS x1, CAST(20 * (n_nationkey // 3) AS DOUBLE) AS y0, CAST(20 * (n_nationkey // 3) + 9 AS DOUBLE) AS y1, n_name AS text FROM nation"


def _objects(spark, sf):
    return load(spark, sf, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS page", "CAST(10 * (n_nationkey % 3) AS DOUBLE) AS x0", "CAST(10 * (n_nationkey % 3) + 8 AS DOUBLE) AS x1", "CAST(20 * (n_nationkey DIV 3) AS DOUBLE) AS y0", "CAST(20 * (n_nationkey DIV 3) + 9 AS DOUBLE) AS y1", "n_name AS text")


@query(f"SELECT page, text, CAST(dense_rank() OVER (PARTITION BY page ORDER BY y0) - 1 AS BIGINT) AS y_group FROM ({_OBJECTS})")
def pdf_group_objects(spark, sf):
    return geometry.groups(_objects(spark, sf), "y").select("page", "text", "y_group")


@query(f"SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY y0) - 1 AS BIGINT) AS y_group, CAST(dense_rank() OVER (PARTITION BY page ORDER BY x0) - 1 AS BIGINT) AS x_group, text FROM ({_OBJECTS})")
def pdf_cells(spark, sf):
    return geometry.cells(_objects(spark, sf))


# ---- streams ----------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return stream.counts(load(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
