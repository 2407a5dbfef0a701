"""Listings, details, changes and indicators; orders, parts and events stand in for tenders, content and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridspark.functions import numbers as N
from hybridspark.functions import text as X
from hybridspark.operators import relational as R
from hybridspark.operators.relations import Relation, Relations
from hybridspark.operators.substring import build_trigrams, substring_matches
from hybridspark.plans.registry import query, table
from hybridspark.sources.schemas import DEFAULT_SECTIONS
from hybridspark.sources.store import dealt

AS_OF = "1998-06-01 12:00:00"


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 20""")
def list_filter_page(spark: SparkSession, d: str) -> DataFrame:
    found = R.where_given(table(spark, d, "orders"), equal={"o_orderstatus": "F", "o_orderpriority": None})
    return R.page(found, "o_orderdate", "o_orderkey", skip=20, limit=20).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'")
def list_total_count(spark: SparkSession, d: str) -> DataFrame:
    return R.total(R.where_given(table(spark, d, "orders"), equal={"o_orderstatus": "O"}, unequal={"o_orderpriority": "1-URGENT"}))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (p_name ILIKE '%a_e%' OR p_type ILIKE '%a_e%')")
def ilike_or_search(spark: SparkSession, d: str) -> DataFrame:
    return R.where_given(table(spark, d, "part"), like={("p_name", "p_type"): "a_e"}).select("p_partkey", "p_name", "p_type")


_PATTERNS = {1: "%a_e%", 2: "%green%", 3: "%brass%", 4: "%PART%1%", 5: "%no such thing%", 6: "%12%"}


@query("WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in _PATTERNS.items()) + ") t(query_id, pattern)) SELECT query_id, p_partkey FROM part, q WHERE p_name ILIKE pattern OR p_type ILIKE pattern")
def ilike_by_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Many patterns at once; those with three letters in a row go by the index, the others by a scan."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    asked = spark.createDataFrame(list(_PATTERNS.items()), "query_id int, query string")
    test = F.expr("p_name ILIKE query OR p_type ILIKE query")
    index = build_trigrams(parts, "p_partkey", F.array("p_name", "p_type"))
    return substring_matches(parts, asked, test, "p_partkey", index=index, ilike=True).select("query_id", "p_partkey")


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS tags FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT string_split(p_name, ' ')[1] FROM part ORDER BY p_partkey LIMIT 1))")
def array_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("tags", X.tags(F.replace("p_name", F.lit(" "), F.lit(","))))
    wanted = parts.orderBy("p_partkey").first()["tags"][0]
    return R.where_given(parts, tags={"tags": wanted}).select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query("""SELECT p_partkey, p_name, coalesce(n, 0) AS usage_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
ORDER BY usage_count DESC, p_partkey LIMIT 20""")
def library_by_usage(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.lit(None).cast("long").alias("usage_count"))
    used = R.add_counts(parts, table(spark, d, "lineitem"), "p_partkey", "l_partkey", "usage_count")
    return R.page(used, "usage_count", "p_partkey")


@query("SELECT user_id, event_id, rank::INT AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS rank FROM events) WHERE rank <= 50")
def history_top50_per_user(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_per(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "rank")


@query("""SELECT o_orderkey, coalesce(n, 0) AS lines_count, coalesce(lines, '') AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n,
string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY coalesce(l_linenumber, 0), l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def detail_with_children(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = R.with_children(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["l_linenumber"], ["l_linenumber", "l_partkey"], "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return rows.select("o_orderkey", "lines_count", text.alias("lines"))


@query("""WITH p AS (SELECT user_id, max(value) AS top, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN user_id IS NOT NULL THEN NULL ELSE c_name END AS c_name, CASE WHEN bought THEN top ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN p ON user_id = c_custkey""")
def patch_update(spark: SparkSession, d: str) -> DataFrame:
    """Every patch clears the name; it sets the balance where the user bought something."""
    patches = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("c_acctbal"), F.bool_or(F.col("event_type") == "purchase").alias("set_c_acctbal"))
    patches = patches.withColumns({"c_name": F.lit(None).cast("string"), "set_c_name": F.lit(True)})
    return R.apply_patch(table(spark, d, "customer"), patches, "c_custkey", ["c_name", "c_acctbal"]).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, (p_size + coalesce(n, 0))::BIGINT AS p_size FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def usage_increment(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return R.add_counts(parts, table(spark, d, "lineitem"), "p_partkey", "l_partkey", "p_size")


@query("""SELECT 'order' AS kind, o_orderkey AS id, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2
UNION ALL SELECT 'line', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = dealt(table(spark, d, "orders"), "o_orderkey"), dealt(table(spark, d, "lineitem"), "l_orderkey")
    left = R.delete_cascade(orders, orders.where("o_orderstatus = 'F'"), "o_orderkey", {"lines": (lines, "l_orderkey")})
    count = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return count(left["parents"], "order", "o_orderkey").unionByName(count(left["lines"], "line", "l_orderkey"))


@query("SELECT count(*) FILTER (l_quantity < 10) AS deleted, count(*) FILTER (NOT l_quantity < 10) AS kept FROM lineitem")
def bulk_delete(spark: SparkSession, d: str) -> DataFrame:
    kept, deleted = R.delete_where(table(spark, d, "lineitem"), F.col("l_quantity") < 10)
    return deleted.crossJoin(kept.agg(F.count("*").alias("kept")))


_TITLES = ", ".join(f"'{t}'" for t in DEFAULT_SECTIONS)


@query(f"SELECT o_orderkey, (unnest(range(0, 8)))::INT AS \"order\", unnest([{_TITLES}]) AS title FROM orders")
def default_children(spark: SparkSession, d: str) -> DataFrame:
    return R.default_children(table(spark, d, "orders"), "o_orderkey", DEFAULT_SECTIONS)


@query("""SELECT n_nationkey, n_name FROM nation UNION ALL
SELECT ((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_name, r_regionkey))::BIGINT, r_name FROM region""")
def insert_rows(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "region").select(F.lit(None).cast("long").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return R.insert(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), new, "n_nationkey")


@query("""SELECT (position - 1)::INT AS position, status, count(o_orderkey) AS n FROM (SELECT unnest(range(1, 6)) AS position, unnest(['draft', 'O', 'P', 'F', 'won']) AS status)
LEFT JOIN orders ON o_orderstatus = status GROUP BY 1, 2""")
def pipeline_by_status(spark: SparkSession, d: str) -> DataFrame:
    return R.by_status(table(spark, d, "orders"), "o_orderstatus", ["draft", "O", "P", "F", "won"])


_DAYS = f"ceil((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000.0)"


@query(f"""SELECT active, won, decided, pending, CASE WHEN decided > 0 THEN round(won / decided * 100)::BIGINT ELSE 0 END AS win_rate FROM (SELECT
count(*) FILTER (o_orderstatus IN ('O', 'P')) AS active, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS decided,
count(*) FILTER ({_DAYS} > 0 AND {_DAYS} <= 14) AS pending FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100))""")
def kpi_win_rate(spark: SparkSession, d: str) -> DataFrame:
    """Over the newest 100 only, as the dashboard that this follows."""
    newest = R.page(table(spark, d, "orders"), "o_orderdate", "o_orderkey", limit=100)
    return R.kpis(newest, "o_orderstatus", "o_orderdate", F.lit(AS_OF).cast("timestamp"), ["O", "P"], "F", "P")


@query(f"""SELECT o_orderkey, {_DAYS}::BIGINT AS days, ({_DAYS} > 0 AND {_DAYS} <= 7) AS urgent, {_DAYS} < 0 AS past, ({_DAYS} > 0 AND {_DAYS} <= 14) AS pending FROM orders""")
def deadline_windows(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    flags = N.deadline_flags(F.col("o_orderdate"), as_of)
    return table(spark, d, "orders").select("o_orderkey", N.days_until(F.col("o_orderdate"), as_of).alias("days"), *(c.alias(n) for n, c in flags.items()))


@query("SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'F') / greatest(count(*), 1) AS share FROM lineitem GROUP BY 1")
def section_progress(spark: SparkSession, d: str) -> DataFrame:
    return R.progress(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", ["F"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def graph_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return R.upsert_latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return R.violations(table(spark, d, "customer"), "c_nationkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice - l_discount > 0 AND l_quantity - l_tax > 0 THEN round((l_extendedprice - l_discount) / (l_quantity - l_tax) * 4 * 100, 2) ELSE 0 END AS cpu,
round(l_quantity / l_extendedprice * 100, 2) AS memory, round(l_extendedprice / 1048576, 2) AS mib FROM lineitem""")
def metrics_formula(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        N.cpu_percent(c("l_extendedprice"), c("l_discount"), c("l_quantity"), c("l_tax"), F.lit(4)).alias("cpu"),
        N.memory_percent(c("l_quantity"), c("l_extendedprice")).alias("memory"),
        N.mebibytes(c("l_extendedprice")).alias("mib"),
    )


@query("SELECT 'orders' AS name, count(*) AS n FROM (DESCRIBE orders) UNION ALL SELECT 'part', count(*) FROM (DESCRIBE part)")
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, len(table(spark, d, t).columns)) for t in ("orders", "part")]
    return spark.createDataFrame(rows, "name string, n long")


_RELATIONS = Relations(
    {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "line_id", "part": "p_partkey"},
    [Relation("orders", "o_custkey", "customer", order=("o_orderkey",)), Relation("lineitem", "l_orderkey", "orders", order=("l_linenumber",), into="lines"), Relation("lineitem", "l_partkey", "part", cascade=False)],
)


def _related(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    lines = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), "l_orderkey", "l_linenumber", "l_partkey")
    return {"customer": table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "orders": table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "lineitem": lines, "part": table(spark, d, "part").select("p_partkey")}


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
SELECT 'customer' AS kind, c_custkey::VARCHAR AS id, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 2
UNION ALL SELECT 'orders', o_orderkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (FROM gone) GROUP BY 2
UNION ALL SELECT 'lineitem', concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey), count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM o) GROUP BY 2""")
def cascade_levels(spark: SparkSession, d: str) -> DataFrame:
    """Customers take their orders with them, and those their lines."""
    tables = _related(spark, d)
    left = _RELATIONS.delete(tables, "customer", tables["customer"].where("c_mktsegment = 'BUILDING'"))
    ids = lambda name, key: dealt(left[name].select(F.col(key).cast("string").alias("id")), "id", rows=tables[name].count())
    count = lambda name, key: ids(name, key).groupBy(F.lit(name).alias("kind"), "id").agg(F.count("*").alias("n"))
    return count("customer", "c_custkey").unionByName(count("orders", "o_orderkey")).unionByName(count("lineitem", "line_id"))


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || '/' || l_partkey, ',' ORDER BY l_linenumber, line_id, l_partkey) AS t FROM (SELECT *, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id FROM lineitem) GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || '=' || coalesce(t, ''), ';' ORDER BY o_orderkey) AS t, sum(coalesce(l.n, 0)) AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS orders_count, coalesce(lines, 0)::BIGINT AS lines, md5(coalesce(t, '')) AS detail_md5 FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def detail_levels(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders, and those with their lines."""
    rows = _RELATIONS.detail(_related(spark, d), "customer", 2)
    lines = lambda o: F.array_join(F.transform(o["lines"], lambda x: F.concat_ws("/", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    text = F.array_join(F.transform("orders", lambda o: F.concat_ws("=", o["o_orderkey"].cast("string"), lines(o))), ";")
    return rows.select("c_custkey", "orders_count", F.aggregate("orders", F.lit(0).cast("long"), lambda s, o: s + o["lines_count"]).alias("lines"), F.md5(text).alias("detail_md5"))


@query("""SELECT 'orders' AS child, 'o_custkey' AS "column", 'customer' AS parent, o_custkey::VARCHAR AS value, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 4
UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 4
UNION ALL SELECT 'lineitem', 'l_partkey', 'part', l_partkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 4""")
def orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """What refers to nothing, once pending orders are taken out without their lines."""
    tables = _related(spark, d)
    return _RELATIONS.orphans(tables | {"orders": tables["orders"].where("o_orderstatus <> 'P'")})


@query("""WITH known AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type <> 'purchase' AND user_id IS NOT NULL),
new AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'purchase')
SELECT event_id, user_id, CASE WHEN user_id IS NULL THEN 'no key' WHEN k IS NOT NULL THEN 'stored already' WHEN nth > 1 THEN 'repeated' ELSE 'in' END AS reason FROM new LEFT JOIN known ON k = user_id""")
def unique_insert(spark: SparkSession, d: str) -> DataFrame:
    """Buyers join the users of all other events; one row a user."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    known, new = events.where("event_type <> 'purchase'"), events.where("event_type = 'purchase'")
    stored, refused = R.insert_unique(known, new, "user_id", ["event_id"])
    entered = stored.where("event_type = 'purchase'").select("event_id", "user_id", F.lit("in").alias("reason"))
    return refused.select("event_id", "user_id", "reason").unionByName(entered)
