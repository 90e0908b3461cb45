"""Plain relational coverage on the star schema."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyarc.catalogue import query
from tallyarc.views import Views


@query("base_join_inner", "SELECT o.o_orderpriority, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate >= @ts'1996-01-01 00:00:00' GROUP BY o.o_orderpriority")
def base_join_inner(v: Views):
    o = v.orders.where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderpriority")
    l = v.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("base_join_left", "SELECT c.c_mktsegment, count(o.o_orderkey) AS orders, count(DISTINCT c.c_custkey) AS customers FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
def base_join_left(v: Views):
    return v.customer.join(v.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("orders"), F.count_distinct("c_custkey").alias("customers"))


@query("base_join_full", "SELECT coalesce(c.n_nationkey, s.n_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) s ON s.n_nationkey = c.n_nationkey")
def base_join_full(v: Views):
    c = v.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = v.supplier.where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full")


@query("base_join_semi", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def base_join_semi(v: Views):
    return v.customer.join(v.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("base_join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def base_join_anti(v: Views):
    return v.customer.join(v.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("base_join_range", "SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON o.o_orderkey BETWEEN e.user_id AND e.user_id + 2 WHERE e.event_id < 500")
def base_join_range(v: Views):
    """A band join: the key is spread over the band's width and joined by equality."""
    own = v.events.where("event_id < 500").select("event_id", F.explode(F.sequence("user_id", F.col("user_id") + 2)).alias("o_orderkey"))
    return own.join(v.orders.select("o_orderkey"), "o_orderkey").select("event_id", "o_orderkey")


@query("base_join_asof", "SELECT e.event_id, max(p.event_id) AS before FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'signup' AND p.event_id < e.event_id WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def base_join_asof(v: Views):
    """The last sign-up before each purchase of a user, by one window instead of a join."""
    last = F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return v.events.select("event_id", "event_type", last.alias("before")).where("event_type = 'purchase'").select("event_id", "before")


@query("base_agg_distinct", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def base_agg_distinct(v: Views):
    return v.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("base_agg_rollup", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def base_agg_rollup(v: Views):
    return v.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("base_agg_cube", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def base_agg_cube(v: Views):
    return v.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@query("base_agg_grouping_sets", "SELECT coalesce(p_brand, '*') AS brand, coalesce(CAST(p_size AS VARCHAR), '*') AS size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def base_agg_grouping_sets(v: Views):
    return v.spark.sql("SELECT coalesce(p_brand, '*') AS brand, coalesce(string(p_size), '*') AS size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())", part=v.part)


@query("base_window_rank", "SELECT * FROM (SELECT c_nationkey, c_custkey, CAST(rank() OVER w AS INTEGER) AS rank, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)) x WHERE rank <= 5")
def base_window_rank(v: Views):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))
    return v.customer.select("c_nationkey", "c_custkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense")).where("rank <= 5")


@query("base_window_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def base_window_frame(v: Views):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0)
    return v.events.select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("base_window_lag", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def base_window_lag(v: Views):
    w = W.partitionBy("user_id").orderBy("event_id")
    return v.events.select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"))


@query("base_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def base_set_union(v: Views):
    return v.customer.select(F.col("c_nationkey").alias("k")).union(v.supplier.select("s_nationkey")).distinct()


@query("base_set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def base_set_intersect(v: Views):
    return v.orders.select(F.col("o_custkey").alias("k")).intersect(v.customer.where("c_acctbal > 5000").select("c_custkey"))


@query("base_set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def base_set_except(v: Views):
    return v.part.select(F.col("p_partkey").alias("k")).subtract(v.lineitem.where("l_quantity > 48").select("l_partkey"))


@query("base_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def base_topk(v: Views):
    return v.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("base_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > 2 * (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def base_subquery(v: Views):
    mean = F.avg("o_totalprice").over(W.partitionBy("o_custkey"))
    return v.orders.withColumn("mean", mean).where("o_totalprice > 2 * mean").select("o_orderkey")


@query("base_pivot", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id")
def base_pivot(v: Views):
    return v.events.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.count(F.lit(1))).na.fill(0)
