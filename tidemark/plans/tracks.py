"""Track scoring, staged matching, retention and windows over events, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import ascii_tokens
from tidemark.operators import spatial, tables, tracks
from tidemark.operators import timeseries as ts
from tidemark.plans.timeline import _E, HOUR, events
from tidemark.streaming import windows as sw


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d19_lag_search(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bin", F.floor(F.col("t") / (24 * HOUR)).cast("long"))
    a, b = (e.filter(F.col("event_type") == k).groupBy("user_id", "bin").agg(F.avg("value").alias("value")) for k in ("view", "click"))
    return tracks.lag_search(a, b, ["user_id"], "bin", "value", list(range(-5, 6)))


def d22_outage_errors(spark, sf_dir):
    e = events(spark, sf_dir)
    v, c = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.avg("value").alias("value")), e.filter("event_type = 'click'").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    gaps = ts.gaps(v, ["user_id"], "t", 24 * HOUR, F.min("t"), F.max("t"))
    got = tracks.outage_errors(gaps, c, v, ["user_id"], "value", 12 * HOUR, 1)
    return got.select("user_id", "from_t", F.round("error", 4).alias("error"))


def e13_backwards(spark, sf_dir):
    return tracks.backwards(events(spark, sf_dir), ["user_id"], "t", "value", 24 * HOUR).select("event_id", F.round("back", 4).alias("back"))


def e17_distance_frame(spark, sf_dir):
    e = ts.running_sum(events(spark, sf_dir), ["user_id"], ["t", "event_id"], (F.col("event_id") % 7 + 0.5).cast("double"), "along")
    return tracks.spread_over(e, ["user_id"], "along", "value", 10.5).select("event_id", F.round("spread", 4).alias("spread"))


def e20_equidistant(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").filter("c_acctbal is not null")
    line = c.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"))
    got = tracks.along_every(spatial.segments(line, ["c_nationkey"], "c_custkey", "x", "y"), ["c_nationkey"], 2500.0)
    return got.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def c20_staged_groups(spark, sf_dir):
    w = ascii_tokens(F.col("text"))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("exact"), F.array_join(F.slice(w, 1, 8), " ").alias("start"), F.size(w).alias("n"))
    return tracks.staged_groups(d, "doc_id", [("exact", F.col("exact")), ("start", F.when(F.col("n") >= 8, F.col("start")))])


def c31_assign_once(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.abs(F.col("l_partkey") - F.col("l_suppkey")) % 50).alias("distance"))
    p = p.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("distance").alias("distance"))
    return tracks.assign_once(p, "l_orderkey", "l_linenumber", "l_suppkey", "distance", 3)


def m10_simplify(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_custkey").cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return tracks.simplify(c, "c_nationkey", "c_custkey", "x", "y", 20.0).select("c_nationkey", "c_custkey")


def a14_changed_rows(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    got = o.join(c, o["o_custkey"] == c["c_custkey"], "left").withColumn("label", F.coalesce("c_mktsegment", F.when(F.col("o_orderstatus") == "F", "closed")))
    return got.filter("label is not null").select("o_orderkey", "label")


def a33_sync(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size")
    side = lambda keep, bump: p.filter(keep).select("p_partkey", F.when(bump, F.concat_ws("-", "p_size", F.lit("x"))).otherwise(F.col("p_size").cast("string")).alias("d"))
    k = F.col("p_partkey")
    local, remote, last = side(k % 7 != 0, k % 5 == 0), side(k % 11 != 0, k % 3 == 0), side(k % 13 != 0, F.lit(False))
    return tables.reconcile(local, remote, last, "p_partkey", "d")


def a35_retention(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("stamp", F.col("o_orderkey"))
    return tables.keep_newest(o, ["o_custkey"], "stamp", 3, F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")).select("o_orderkey")


def p16_leave_one_out(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("own"))
    total = n.groupBy("event_type").agg(F.sum("own").alias("everyone"))
    return n.join(total, "event_type").select("user_id", "event_type", (F.col("everyone") - F.col("own")).alias("others"))


def p20_last_known(spark, sf_dir):
    e = events(spark, sf_dir)
    got = ts.asof(e, e.filter("event_type = 'purchase'"), ["user_id"], "t", ["event_id"], tie="event_id")
    return got.select("event_id", F.col("match.event_id").alias("last_purchase"))


def l4_sliding_windows(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sw.sliding(e, "ts", ["event_type"], "6 hours", "1 hour", "1 hour", F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))
    return got.select("event_type", F.unix_seconds(F.col("window.start")).alias("start_s"), "n", "mean")


def l6_session_windows(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sw.sessions(e, "ts", ["user_id"], "12 hours", "1 hour", F.count("*").alias("n"))
    return got.select("user_id", F.unix_micros(F.col("session_window.start")).alias("start_t"), "n")


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "acdelmp" and k[1:2].isdigit()}
_SYNC = "(SELECT p_partkey, CASE WHEN {1} THEN p_size || '-x' ELSE CAST(p_size AS VARCHAR) END AS d FROM part WHERE {0})"
ORACLES = {
    "d19_lag_search": f"""WITH {_E}, g AS (SELECT user_id, event_type, t // {24 * HOUR} AS bin, avg(value) AS value FROM e GROUP BY 1, 2, 3), l AS (SELECT unnest(range(-5, 6)) AS lag),
        s AS (SELECT a.user_id, lag, round(avg(power(a.value - b.value, 2)), 6) AS sse, count(*) AS n FROM g a JOIN l ON true JOIN g b ON b.user_id = a.user_id AND b.event_type = 'click' AND b.bin + lag = a.bin WHERE a.event_type = 'view' GROUP BY 1, 2)
        SELECT user_id, CAST(lag AS INTEGER) AS lag, sse FROM s WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sse, lag) = 1""",
    "d22_outage_errors": f"""WITH {_E}, g AS (SELECT user_id, event_type, t, avg(value) AS value FROM e GROUP BY 1, 2, 3), v AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM g WHERE event_type = 'view'),
        j AS (SELECT v.user_id, v.p AS from_t, v.t, v.value, c.t AS ct, c.value AS cv FROM v JOIN g c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.t <= v.t - 1 AND v.t - 1 - c.t <= {12 * HOUR} WHERE v.t - v.p > {24 * HOUR})
        SELECT user_id, from_t, round(abs(cv - value), 4) AS error FROM j QUALIFY row_number() OVER (PARTITION BY user_id, from_t ORDER BY ct DESC) = 1""",
    "e13_backwards": f"WITH {_E} SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) - value, 4) AS back FROM e",
    "e17_distance_frame": f"""WITH {_E}, a AS (SELECT *, CAST(sum(event_id % 7 + 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS along FROM e)
        SELECT event_id, round(max(value) OVER w - min(value) OVER w, 4) AS spread FROM a WINDOW w AS (PARTITION BY user_id ORDER BY along RANGE BETWEEN 10.5 PRECEDING AND CURRENT ROW)""",
    "e20_equidistant": """WITH s AS (SELECT c_nationkey, c_custkey, abs(lead(c_acctbal) OVER w - c_acctbal) AS len FROM customer WHERE c_acctbal IS NOT NULL WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
        t AS (SELECT c_nationkey, sum(len) AS total FROM s GROUP BY 1) SELECT c_nationkey, CAST(floor(total / 2500) + 1 AS BIGINT) AS n FROM t""",
    "c20_staged_groups": """WITH d AS (SELECT doc_id, md5(text) AS k1, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), a AS (SELECT *, min(doc_id) OVER (PARTITION BY k1) AS g1, count(*) OVER (PARTITION BY k1) AS n1, CASE WHEN len(w) >= 8 THEN array_to_string(w[1:8], ' ') END AS k2 FROM d),
        b AS (SELECT *, min(doc_id) OVER (PARTITION BY k2) AS g2, count(*) OVER (PARTITION BY k2) AS n2 FROM a WHERE n1 = 1)
        SELECT doc_id, 'exact' AS stage, g1 AS grp FROM a WHERE n1 > 1 UNION ALL SELECT doc_id, CASE WHEN k2 IS NOT NULL AND n2 > 1 THEN 'start' ELSE 'single' END, CASE WHEN k2 IS NOT NULL AND n2 > 1 THEN g2 ELSE doc_id END FROM b""",
    "c31_assign_once": """WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS g, l_suppkey AS s, abs(l_partkey - l_suppkey) % 50 AS d FROM lineitem), q AS (SELECT o, g, s, min(d) AS d FROM p GROUP BY 1, 2, 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY g, d, s) AS i FROM q),
        r AS (SELECT o, g, s, i, [s] AS taken, 1 AS held, true AS got FROM n WHERE i = 1
        UNION ALL SELECT o, g, s, i, CASE WHEN ok THEN list_append(taken, s) ELSE taken END, CASE WHEN ok THEN h + 1 ELSE h END, ok FROM (SELECT *, NOT list_contains(taken, s) AND h < 3 AS ok FROM (SELECT n.o, n.g, n.s, n.i, r.taken, CASE WHEN n.g = r.g THEN r.held ELSE 0 END AS h FROM r JOIN n ON n.o = r.o AND n.i = r.i + 1)))
        SELECT o AS l_orderkey, g AS l_linenumber, s AS l_suppkey FROM r WHERE got""",
    "a14_changed_rows": "SELECT o_orderkey, coalesce(c_mktsegment, CASE WHEN o_orderstatus = 'F' THEN 'closed' END) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_custkey WHERE label IS NOT NULL",
    "a33_sync": f"""WITH a AS {_SYNC.format("p_partkey % 7 <> 0", "p_partkey % 5 = 0")}, b AS {_SYNC.format("p_partkey % 11 <> 0", "p_partkey % 3 = 0")}, c AS {_SYNC.format("p_partkey % 13 <> 0", "false")},
        j AS (SELECT p_partkey, a.d AS a, b.d AS b, c.d AS c FROM a FULL JOIN b USING (p_partkey) FULL JOIN c USING (p_partkey))
        SELECT p_partkey, CASE WHEN a = b THEN 'same' WHEN a IS NULL AND c IS NOT NULL AND b = c THEN 'gone here' WHEN b IS NULL AND c IS NOT NULL AND a = c THEN 'gone there' WHEN b IS NOT DISTINCT FROM c THEN 'push' WHEN a IS NOT DISTINCT FROM c THEN 'pull' ELSE 'edited on both' END AS action FROM j WHERE a IS NOT NULL OR b IS NOT NULL""",
    "a35_retention": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3 OR o_orderdate >= TIMESTAMP '1997-06-01'",
    "p16_leave_one_out": "WITH n AS (SELECT user_id, event_type, count(*) AS own FROM events GROUP BY 1, 2) SELECT user_id, event_type, CAST(sum(own) OVER (PARTITION BY event_type) - own AS BIGINT) AS others FROM n",
    "p20_last_known": f"WITH {_E} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM e",
    "l4_sliding_windows": f"""WITH {_E}, w AS (SELECT event_type, value, (t // {HOUR} - unnest(range(0, 6))) * 3600 AS start_s FROM e) SELECT event_type, start_s, count(*) AS n, round(avg(value), 8) AS mean FROM w GROUP BY 1, 2""",
    "l6_session_windows": f"""WITH {_E}, p AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM p)
        SELECT user_id, min(t) AS start_t, count(*) AS n FROM r GROUP BY user_id, run""",
}
