"""Registered queries of the relational operators (R); most texts run on both engines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans.relational import scalar_max, scalar_min, total
from ..session import tune
from ..sources.tables import read_table

C = F.col
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def shared(name: str, text: str, *args) -> None:
    """One text for both engines; tables are written ``{orders}`` and parameters ``?``."""

    def run(spark, directory):
        tune(spark)
        frames = {table: read_table(spark, directory, table) for table in set(re.findall(r"\{(\w+)\}", text))}
        return spark.sql(text, args=list(args), **frames) if args else spark.sql(text, **frames)

    oracle = re.sub(r"\{(\w+)\}", r"\1", text)
    for value in args:
        oracle = oracle.replace("?", repr(value), 1)
    QUERIES[name], ORACLE[name] = run, oracle


shared("r01_projection", "SELECT o_orderkey AS order_key, o_orderstatus AS state, o_totalprice AS price FROM {orders}")
shared(
    "r02_filter",
    "SELECT o_orderkey, o_custkey FROM {orders} WHERE (o_totalprice > ? AND o_orderstatus = ?) OR NOT (o_custkey > ?) OR o_orderkey IS NULL",
    150000.0,
    "O",
    20,
)
shared(
    "r03_case_cast",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CAST(o_orderkey AS STRING) AS txt, "
    "o_orderkey div 7 AS sevenths, CAST((100 - o_orderkey) div 7 AS BIGINT) AS below FROM {orders}",
)
ORACLE["r03_case_cast"] = ORACLE["r03_case_cast"].replace("o_orderkey div 7", "CAST(trunc(o_orderkey / 7) AS BIGINT)").replace(
    "(100 - o_orderkey) div 7", "trunc((100 - o_orderkey) / 7)"
)
shared(
    "r04_inner_join",
    "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_nationkey FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey "
    "JOIN {customer} c ON c.c_custkey = o.o_custkey",
)
shared(
    "r05_left_anti_expiry",
    "SELECT c.c_custkey FROM {customer} c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS newest FROM {orders} GROUP BY o_custkey) o "
    "ON o.o_custkey = c.c_custkey WHERE o.o_custkey IS NULL OR o.newest <= ?",
    9000,
)
shared(
    "r06_theta_join",
    "SELECT n.n_nationkey, r.r_regionkey FROM {nation} n JOIN {region} r ON n.n_regionkey < r.r_regionkey",
)
shared(
    "r07_group_by",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_linenumber AS BIGINT)) AS numbers FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
)
ORACLE["r07_group_by"] = ORACLE["r07_group_by"].replace(
    "sum(CAST(l_linenumber AS BIGINT))", "CAST(sum(l_linenumber) AS BIGINT)"
)


def _functions(spark, directory):
    tune(spark)
    events = read_table(spark, directory, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    rare = F.when(C("k") > 90, C("k"))
    return events.groupBy("user_id").agg(
        F.avg("k").alias("mean"),
        F.count("k").alias("n"),
        F.max("k").alias("high"),
        F.min("k").alias("low"),
        F.sum("k").alias("summed"),
        total(rare).alias("total_rare"),
        F.max(scalar_max(C("k"), C("event_id"))).alias("greater"),
        F.min(scalar_min(C("k"), rare)).alias("lesser"),
        F.ifnull(F.max(rare), F.lit(-1)).alias("rare_or_minus"),
    )


QUERIES["r08_functions"] = _functions
ORACLE["r08_functions"] = (
    "SELECT user_id, avg(k) AS mean, count(k) AS n, max(k) AS high, min(k) AS low, CAST(sum(k) AS BIGINT) AS summed, "
    "COALESCE(sum(CASE WHEN k > 90 THEN k END)::DOUBLE, 0.0) AS total_rare, max(greatest(k, event_id)) AS greater, "
    "min(CASE WHEN k > 90 THEN k END) AS lesser, COALESCE(max(CASE WHEN k > 90 THEN k END), -1) AS rare_or_minus "
    "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id"
)
shared(
    "r09_scalar_subquery",
    "SELECT event_id, user_id FROM {events} WHERE value > (SELECT avg(value) FROM {events}) AND user_id = (SELECT max(user_id) FROM {events})",
)
shared(
    "r10_recursive_cte",
    "WITH RECURSIVE chain(parent, level) AS (SELECT CAST(max(c_custkey) AS BIGINT) AS parent, CAST(0 AS BIGINT) AS level FROM {customer} "
    "UNION ALL SELECT CAST(floor(parent / 2) AS BIGINT), level + 1 FROM chain WHERE parent > 1) "
    "SELECT c.level, k.c_custkey, k.c_nationkey FROM chain c JOIN {customer} k ON k.c_custkey = c.parent",
)
shared(
    "r11_set_operations",
    "(SELECT o_custkey AS key FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O') "
    "UNION SELECT c_custkey FROM {customer} WHERE c_nationkey = 3 EXCEPT SELECT c_custkey FROM {customer} WHERE c_nationkey = 5",
)
shared("r12_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
shared("r13_distinct", "SELECT DISTINCT user_id, event_type FROM {events}")
shared(
    "r13_count_distinct",
    "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(value AS INT)) AS amounts FROM {events} GROUP BY event_type",
)
ORACLE["r13_count_distinct"] = ORACLE["r13_count_distinct"].replace("CAST(value AS INT)", "CAST(trunc(value) AS INT)")
shared(
    "r14_window_aggregate",
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS running, "
    "max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top FROM {lineitem}",
)
