"""The general relational surface on the plain tables: joins, windows, sets, grouping sets, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compass, heading_of, wrap180
from ..sources.tables import table, timed_table
from .aggregates import rnd
from .base import POINTS, points, r, sql
from .registry import query


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_orderpriority")
def rel_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_join_left(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def rel_join_full(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_join_semi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_join_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def rel_join_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Two fixed dimensions."""
    return table(spark, sf, "region").select("r_name").crossJoin(F.broadcast(table(spark, sf, "nation").select("n_name")))


@query("SELECT s_suppkey, " + r("sum(l_extendedprice * (1 - l_discount))", 2) + " AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 GROUP BY s_suppkey")
def rel_filter_join_agg(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_discount between 0.05 and 0.07 and l_quantity < 24")
    return rnd(li.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")), 2)


@query("SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR GROUP BY a.event_id")
def rel_join_range(spark: SparkSession, sf: str) -> DataFrame:
    """An interval join in buckets of its length."""
    e = timed_table(spark, sf, "events").withColumn("s", F.col("ts").cast("double"))
    k = F.floor(F.col("s") / 7200)
    a = e.select("event_id", "user_id", F.col("s").alias("s1"), F.explode(F.array(k, k + 1)).alias("k"))
    b = e.select("user_id", F.col("s").alias("s2"), k.alias("k"))
    return a.join(b, ["user_id", "k"]).where("s2 > s1 and s2 <= s1 + 7200").groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, arg_max(e.event_id, e.ts) AS event_id FROM (SELECT o_orderkey, o_custkey % 100 AS u, o_orderdate FROM orders) o JOIN events e ON e.user_id = o.u AND e.ts <= o.o_orderdate + INTERVAL 30 YEAR GROUP BY o_orderkey")
def rel_join_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of a user before a moment: union, order and fill forward, one shuffle on the user."""
    o = timed_table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("user_id"), (F.col("o_orderdate") + F.expr("interval 30 years")).cast("timestamp").alias("at"), "o_orderkey", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    e = timed_table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), F.lit(None).cast("long").alias("o_orderkey"), "event_id", F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    j = o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).where("side = 1 and event_id is not null")
    return j.groupBy("o_orderkey").agg(F.max("event_id").alias("event_id"))


@query("SELECT l_returnflag, l_linestatus, " + r("sum(l_quantity)", 2) + " AS qty, count(*) AS n, grouping(l_returnflag) + 0 AS g1, grouping(l_linestatus) + 0 AS g2 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def rel_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    return rnd(g.agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2")), 2)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rel_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def rel_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rk, coalesce(lag(event_id) OVER w, -1) AS before, coalesce(lead(event_id, 2) OVER w, -1) AS after2, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rel_window_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("rk"), F.lag("event_id", 1, -1).over(w).alias("before"), F.lead("event_id", 2, -1).over(w).alias("after2"), F.first("event_id").over(w).alias("first"))


@query("SELECT event_id, " + r("avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)") + " AS mean5, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day FROM events")
def rel_window_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_table(spark, sf, "events").withColumn("us", F.unix_micros("ts"))
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    span = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return rnd(e.select("event_id", F.avg("value").over(rows).alias("mean5"), F.count("*").over(span).alias("day")))


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer")
def rel_set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_custkey").intersect(table(spark, sf, "customer").select("c_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def rel_set_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").exceptAll(table(spark, sf, "orders").select("o_custkey").distinct()).distinct()


@query("SELECT n_name AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) GROUP BY n_name")
def rel_set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionAll(table(spark, sf, "region").select("r_name")).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def rel_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report."""
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def rel_top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_type", "event_id")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view FROM events GROUP BY user_id")
def rel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count(F.lit(1))).na.fill(0, ["click", "view"])


@query("SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS median, mode AS mode, " + r("sd") + " AS sd, " + r("rho") + " AS rho FROM (SELECT l_suppkey, l_quantity FROM lineitem) JOIN (SELECT l_suppkey, min(l_quantity) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS m FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE n = m GROUP BY l_suppkey) USING (l_suppkey) JOIN (SELECT l_suppkey, stddev_samp(l_quantity) AS sd, corr(l_quantity, l_extendedprice) AS rho FROM lineitem GROUP BY l_suppkey) USING (l_suppkey) GROUP BY l_suppkey, mode, sd, rho")
def rel_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).alias("median"), F.mode("l_quantity", True).alias("mode"), F.stddev_samp("l_quantity").alias("sd"), F.corr("l_quantity", "l_extendedprice").alias("rho")))


@query(sql(POINTS, then="SELECT clip, track_id, frame, " + r("degrees(atan2(vx, vy)) + 360.0 - 360.0 * floor((degrees(atan2(vx, vy)) + 360.0) / 360.0)", 2) + " AS heading, " + r("(heading - 90.0 + 180.0) - 360.0 * floor((heading - 90.0 + 180.0) / 360.0) - 180.0", 2) + " AS off_east, (['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'])[CAST(floor((heading + 11.25) / 22.5) AS BIGINT) % 16 + 1] AS wind FROM p WHERE vx IS NOT NULL AND vy IS NOT NULL AND heading IS NOT NULL"))
def fun_angles(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).where("vx is not null and vy is not null and heading is not null")
    return rnd(p.select("clip", "track_id", "frame", heading_of(F.col("vx"), F.col("vy")).alias("heading"), wrap180(F.col("heading") - 90.0).alias("off_east"), compass(F.col("heading")).alias("wind")), 2)


@query("SELECT track_id, string_split(tracker_ids, '+')[1] AS first_id, CAST(len(string_split(tracker_ids, '+')) AS INTEGER) AS n, lower(trim(\"group\")) AS grp, regexp_matches(clip, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$') AS named FROM track_summary")
def fun_strings(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.split("tracker_ids", "\\+")
    return table(spark, sf, "track_summary").select("track_id", F.get(ids, 0).alias("first_id"), F.size(ids).alias("n"), F.lower(F.trim("group")).alias("grp"), F.regexp_like("clip", F.lit("^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$")).alias("named"))


@query("SELECT clip, strftime(started_at, '%Y-%m-%d') AS day, hour(started_at) AS hour, CAST(floor((end_frame - start_frame) / CAST(fps AS DOUBLE) / 60) AS BIGINT) AS minutes FROM clips")
def fun_times(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "clips").withColumn("at", F.col("started_at").cast("timestamp"))
    return c.select("clip", F.date_format("at", "yyyy-MM-dd").alias("day"), F.hour("at").cast("long").alias("hour"), F.floor((F.col("end_frame") - F.col("start_frame")) / F.col("fps") / 60).alias("minutes"))


@query("SELECT zone_id, CAST(len(ring_x) AS INTEGER) AS corners, " + r("list_max(ring_x) - list_min(ring_x)") + " AS width, " + r("list_sum(ring_x) / len(ring_x) - ring_x[1]") + " AS off FROM zones")
def fun_arrays(spark: SparkSession, sf: str) -> DataFrame:
    z = table(spark, sf, "zones")
    return rnd(z.select("zone_id", F.size("ring_x").alias("corners"), (F.array_max("ring_x") - F.array_min("ring_x")).alias("width"), (F.aggregate("ring_x", F.lit(0.0), lambda a, v: a + v) / F.size("ring_x") - F.get("ring_x", F.lit(0))).alias("off")))


@query("SELECT user_id, count(*) AS n, min(ts) AS start_at FROM (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s")
def rel_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = timed_table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "21601 seconds")).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("start_at")).drop("session_window")


@query(sql(POINTS, "q AS (SELECT clip, track_id, frame, least(greatest((speed - 0.0) / 10.0, 0.0), 1.0) * 2 AS z FROM p WHERE speed IS NOT NULL)", "k AS (SELECT *, least(floor(z), 1) AS k FROM q)", then="SELECT clip, track_id, frame, " + r("CASE k WHEN 0 THEN 20.0 + z * 180.0 ELSE 200.0 + (z - 1) * 50.0 END", 3) + " AS red FROM k"))
def fun_colour_ramp(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import ramp

    p = points(spark, sf).where("speed is not null")
    return rnd(p.select("clip", "track_id", "frame", F.get(ramp(F.col("speed"), 0.0, 10.0, [(20.0, 0.0, 90.0), (200.0, 80.0, 60.0), (250.0, 240.0, 120.0)]), F.lit(0)).alias("red")), 3)
