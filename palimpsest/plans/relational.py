"""Registered queries: event-time windows over stored events and plain relational plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as s
from ..sources.tables import table
from .registry import query


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS first FROM events),
n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS n FROM n GROUP BY user_id, k"""
)
def session_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "n")


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def cube_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(s.small(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08)")
def semi_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(l, "s_suppkey", "left_semi")


@query("SELECT doc_id, source, n_chars, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)")
def window_ranks(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("SELECT conv_id, c.first_role, n.turns FROM (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations WHERE turn < 2 GROUP BY 1) c FULL JOIN (SELECT conv_id, count(*) AS turns FROM conversations WHERE turn >= 2 GROUP BY 1) n USING (conv_id)")
def full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.where("turn < 2").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    return a.join(c.where("turn >= 2").groupBy("conv_id").agg(F.count("*").alias("turns")), "conv_id", "full")
