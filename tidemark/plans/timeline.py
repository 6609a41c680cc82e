"""Queries over events as sensor streams: user_id is the trip, event_type the channel, value the reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import conv
from tidemark.functions.times import micros, week_minute
from tidemark.operators import aggregate as ag
from tidemark.operators import timeseries as ts
from tidemark.operators.tables import cut

HOUR = 3_600_000_000


def events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("t"))


def _split(spark, sf_dir, a, b):
    e = events(spark, sf_dir)
    return e.filter(F.col("event_type") == a), e.filter(F.col("event_type") == b)


_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events)"


def c1_asof_join(spark, sf_dir):
    p, v = _split(spark, sf_dir, "purchase", "view")
    got = ts.asof(p, v, ["user_id"], "t", ["event_id", "value"], tolerance=24 * HOUR, tie="event_id")
    return got.select("event_id", "user_id", F.col("match.event_id").alias("view_id"), F.round("match.value", 4).alias("view_value"))


def c3_nearest_join(spark, sf_dir):
    p, v = _split(spark, sf_dir, "purchase", "view")
    got = ts.nearest(p, v, ["user_id"], "t", ["event_id"], tie="event_id")
    return got.select("event_id", F.abs(F.col("match.t") - F.col("t")).alias("apart"))


def c4_interpolating_join(spark, sf_dir):
    c, v = _split(spark, sf_dir, "click", "view")
    v = v.groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    got = ts.interpolate(c, v, ["user_id"], "t", "value", gap=24 * HOUR, hold=2 * HOUR)
    return got.select("event_id", F.round("value_at", 3).alias("value_at"))


def c7_interval_containment(spark, sf_dir):
    p, w = _split(spark, sf_dir, "view", "purchase")
    windows = w.select("user_id", F.col("t").alias("from_t"), (F.col("t") + 6 * HOUR).alias("to_t")).distinct()
    got = ts.inside_windows(p, windows, ["user_id"], "t")
    return got.select("event_id", "from_t")


def c9_sorted_merge(spark, sf_dir):
    rank = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = events(spark, sf_dir).withColumn("source_rank", rank)
    return ts.numbered(e, ["user_id"], ["t", "source_rank", "event_id"]).select("event_id", "place")


def c10_prefer_fresh(spark, sf_dir):
    v, c = _split(spark, sf_dir, "view", "click")
    return ts.prefer_fresh(v, c, ["user_id"], "t", 12 * HOUR).select("event_id", "event_type")


def d2_event_rate(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(conv.rate_hz(F.col("t")) * 3600, 6).alias("per_hour"))


def d3_hop_sum(spark, sf_dir):
    e = ts.previous(events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["value"])
    hop = F.abs(F.col("value") - F.col("prev.value"))
    return e.groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.when((F.col("value") > 1) & (F.col("prev.value") > 1), hop)), F.lit(0.0)), 3).alias("distance"))


def d6_quality_findings(spark, sf_dir):
    e = ts.previous(events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t", "event_id"])
    e = cut(e.select("user_id", ((F.col("t") - F.col("prev.t")) / 1e6).alias("gap"), (F.col("event_id") < F.col("prev.event_id")).alias("back")))
    all_ = e.groupBy("user_id").agg(F.max("gap").alias("longest_s"), F.count_if("back").alias("backwards"))
    med = ag.quantiles(e, ["user_id"], "gap", {"median_s": ("linear", 0.5)})
    dev = e.join(med, "user_id").withColumn("off", F.abs(F.col("gap") - F.col("median_s")))
    dev = ag.quantiles(dev, ["user_id"], "off", {"mad_s": ("linear", 0.5)})
    return all_.join(med, "user_id").join(dev, "user_id").select("user_id", F.round("median_s", 3).alias("median_s"), F.round("longest_s", 3).alias("longest_s"), "backwards", F.round("mad_s", 3).alias("mad_s"))


def d7_periodicity(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    both = e.withColumn("hours", F.explode(F.sequence(F.lit(1), F.lit(48))))
    angle = F.pmod(F.col("t"), F.col("hours") * HOUR) / (F.col("hours") * HOUR) * 2 * F.pi()
    got = both.groupBy("hours").agg(F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle))).alias("c"))
    return got.select(F.col("hours").cast("long").alias("hours"), F.round("c", 6).alias("coherence"))


def d9_mode_first_tie(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "seen", "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("mode"), (-F.col("b.n")).alias("n"))


def d12_tumbling_mean(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / HOUR).cast("long").alias("bin"))
    return e.agg(F.round(F.avg("value"), 4).alias("mean_value"), F.floor(F.avg(F.col("t") - F.lit(1_700_000_000_000_000)) / 1e6).cast("long").alias("mean_s"), F.count("*").alias("n"))


def d24_clipped_integral(spark, sf_dir):
    e = events(spark, sf_dir)
    lo, hi = 1_704_067_200_000_000 + 5 * 24 * HOUR, 1_704_067_200_000_000 + 15 * 24 * HOUR
    return ts.held_integral(e, ["user_id"], ["t", "event_id"], "value", lo, hi, 48 * HOUR).select("user_id", F.round("integral", 1).alias("integral"))


def d27_floor_quantiles(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = ag.quantiles(p, ["l_suppkey"], "l_extendedprice", {"p50": ("floor", 0.5), "p90": ("floor", 0.9), "p99_linear": ("linear", 0.99)})
    return got.withColumn("p99_linear", F.round("p99_linear", 4))


def d49_poll_statistics(spark, sf_dir):
    e = ts.over_frame(events(spark, sf_dir), ["user_id"], "t", 24 * HOUR, {"errors": lambda w: F.count(F.when(F.col("event_type") == "error", 1)).over(w)})
    e = ts.numbered(e, ["user_id"], ["t", "event_id"])
    e = ts.over_frame(e, ["user_id"], "place", 99, {"last": lambda w: F.collect_list("value").over(w)}, width=10_000).withColumn("last", F.array_sort("last"))
    at = lambda q: F.element_at("last", F.least(F.size("last"), F.floor(F.lit(q) * F.size("last")) + 1).cast("int"))
    return e.select("event_id", at(0.5).alias("p50"), at(0.95).alias("p95"), "errors")


def e3_rolling_stats(spark, sf_dir):
    e = ts.numbered(events(spark, sf_dir), ["user_id"], ["t", "event_id"])
    of = {"n": lambda w: F.count("value").over(w), "mean": lambda w: F.avg("value").over(w), "sd": lambda w: F.stddev_samp("value").over(w)}
    e = ts.over_frame(e, ["user_id"], "place", 9, of, width=10_000)
    return e.select("event_id", F.round("mean", 6).alias("mean10"), F.round(F.when(F.col("n") < 2, -1.0).otherwise(F.col("sd")), 3).alias("std10"))


def e5_gap_detection(spark, sf_dir):
    e = events(spark, sf_dir)
    lo, hi = F.lit(1_704_067_200_000_000), F.lit(1_706_745_600_000_000)
    return ts.gaps(e, ["user_id"], "t", 12 * HOUR, lo, hi)


def e6_session_islands(spark, sf_dir):
    e = ts.islands(events(spark, sf_dir), ["user_id"], ["t", "event_id"], 12 * HOUR)
    got = e.groupBy("user_id", "run").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return got.withColumn("run", F.col("run").cast("long"))


def e8_state_changes(spark, sf_dir):
    e = ts.previous(events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["event_type"])
    return e.filter(F.col("prev.event_type").isNotNull() & (F.col("event_type") != F.col("prev.event_type"))).select("event_id", F.col("prev.event_type").alias("from_type"), F.col("event_type").alias("to_type"))


def e19_grid_resample(spark, sf_dir):
    v = events(spark, sf_dir).filter("event_type = 'view'")
    g = ts.grid(v, ["user_id"], "t", 6 * HOUR)
    got = ts.asof(g, v, ["user_id"], "t", ["value"], tie="event_id")
    return got.select("user_id", "t", F.round("match.value", 4).alias("value"))


def g6_interval_union(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = micros(F.col("o_orderdate"))
    spans = o.select("o_custkey", d.alias("from_t"), (d + 45 * 24 * HOUR).alias("to_t"))
    return ts.merge_intervals(spans, ["o_custkey"], "from_t", "to_t")


def t1_week_minutes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy((F.floor(week_minute(F.col("ts")) / 60)).cast("long").alias("week_hour")).agg(F.count("*").alias("n"))


_ASOF = "(SELECT v.event_id FROM e v WHERE v.user_id = p.user_id AND v.event_type = '{kind}' AND v.t <= p.t ORDER BY v.t DESC, v.event_id DESC LIMIT 1)"

QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "cdegt" and k[1:2].isdigit()}
ORACLES = {
    "c1_asof_join": f"""WITH {_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), m AS (
        SELECT p.event_id, p.user_id, p.t, v.event_id AS view_id, v.value, v.t AS vt, row_number() OVER (PARTITION BY p.event_id ORDER BY v.t DESC, v.event_id DESC) AS r
        FROM e p LEFT JOIN v ON v.user_id = p.user_id AND v.t <= p.t WHERE p.event_type = 'purchase')
        SELECT event_id, user_id, CASE WHEN t - vt <= {24 * HOUR} THEN view_id END AS view_id, CASE WHEN t - vt <= {24 * HOUR} THEN round(value, 4) END AS view_value FROM m WHERE r = 1""",
    "c3_nearest_join": f"""WITH {_E} SELECT p.event_id, min(abs(v.t - p.t)) AS apart FROM e p LEFT JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase' GROUP BY 1""",
    "c4_interpolating_join": f"""WITH {_E}, v AS (SELECT user_id, t, avg(value) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2),
        b AS (SELECT c.event_id, c.t, max_by(v.value, v.t) AS pv, max(v.t) AS pt FROM e c LEFT JOIN v ON v.user_id = c.user_id AND v.t <= c.t WHERE c.event_type = 'click' GROUP BY 1, 2),
        a AS (SELECT c.event_id, min_by(v.value, v.t) AS nv, min(v.t) AS nt FROM e c LEFT JOIN v ON v.user_id = c.user_id AND v.t >= c.t WHERE c.event_type = 'click' GROUP BY 1)
        SELECT event_id, round(CASE WHEN pt IS NULL THEN NULL WHEN nt IS NOT NULL AND nt - pt <= {24 * HOUR} THEN CASE WHEN nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END
          WHEN t - pt <= {2 * HOUR} THEN pv END, 3) AS value_at FROM b JOIN a USING (event_id)""",
    "c7_interval_containment": f"""WITH {_E} SELECT v.event_id, min(p.t) AS from_t FROM e v LEFT JOIN e p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND v.t >= p.t AND v.t < p.t + {6 * HOUR} WHERE v.event_type = 'view' GROUP BY 1""",
    "c9_sorted_merge": f"""WITH {_E} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) AS place FROM e""",
    "c10_prefer_fresh": f"""WITH {_E}, c AS (SELECT c.event_id, c.t, max(v.t) AS vt FROM e c LEFT JOIN e v ON v.event_type = 'view' AND v.user_id = c.user_id AND v.t <= c.t WHERE c.event_type = 'click' GROUP BY 1, 2)
        SELECT event_id, 'view' AS event_type FROM e WHERE event_type = 'view' UNION ALL SELECT event_id, 'click' FROM c WHERE vt IS NULL OR t - vt > {12 * HOUR}""",
    "d2_event_rate": f"""WITH {_E} SELECT user_id, count(*) AS n, round(coalesce((count(*) - 1) / nullif((max(t) - min(t)) / 1e6, 0), 0) * 3600, 6) AS per_hour FROM e GROUP BY 1""",
    "d3_hop_sum": f"""WITH {_E}, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pv FROM e) SELECT user_id, round(coalesce(sum(CASE WHEN value > 1 AND pv > 1 THEN abs(value - pv) END), 0), 3) AS distance FROM p GROUP BY 1""",
    "d6_quality_findings": f"""WITH {_E}, p AS (SELECT user_id, (t - lag(t) OVER w) / 1e6 AS gap, event_id < lag(event_id) OVER w AS back FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        m AS (SELECT user_id, quantile_cont(gap, 0.5) AS med, max(gap) AS longest, count(*) FILTER (back) AS backwards FROM p GROUP BY 1),
        d AS (SELECT user_id, quantile_cont(abs(gap - med), 0.5) AS mad FROM p JOIN m USING (user_id) GROUP BY 1)
        SELECT user_id, round(med, 3) AS median_s, round(longest, 3) AS longest_s, backwards, round(mad, 3) AS mad_s FROM m JOIN d USING (user_id)""",
    "d7_periodicity": f"""WITH {_E}, h AS (SELECT unnest(range(1, 49)) AS hours), a AS (SELECT hours, (t % (hours * {HOUR}))::DOUBLE / (hours * {HOUR}) * 2 * pi() AS x FROM e, h WHERE event_type = 'purchase')
        SELECT hours, round(sqrt(avg(cos(x)) * avg(cos(x)) + avg(sin(x)) * avg(sin(x))), 6) AS coherence FROM a GROUP BY 1""",
    "d9_mode_first_tie": f"""WITH {_E}, n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM e GROUP BY 1, 2) SELECT user_id, event_type AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1""",
    "d12_tumbling_mean": f"""WITH {_E} SELECT event_type, t // {HOUR} AS bin, round(avg(value), 4) AS mean_value, CAST(floor(avg(t - 1700000000000000) / 1e6) AS BIGINT) AS mean_s, count(*) AS n FROM e GROUP BY 1, 2""",
    "d24_clipped_integral": f"""WITH {_E}, p AS (SELECT user_id, t, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
        SELECT user_id, round(coalesce(sum(CASE WHEN t - pt <= {48 * HOUR} THEN pv * greatest(0, least(t, {1_704_067_200_000_000 + 15 * 24 * HOUR}) - greatest(pt, {1_704_067_200_000_000 + 5 * 24 * HOUR})) / 1e6 END), 0), 1) AS integral FROM p GROUP BY 1""",
    "d27_floor_quantiles": """WITH q AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS a, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1)
        SELECT l_suppkey, a[least(len(a), CAST(floor(0.5 * len(a)) AS BIGINT) + 1)] AS p50, a[least(len(a), CAST(floor(0.9 * len(a)) AS BIGINT) + 1)] AS p90, round(p99, 4) AS p99_linear FROM q""",
    "d49_poll_statistics": f"""WITH {_E}, q AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 99 PRECEDING)) AS a,
        count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS errors FROM e)
        SELECT event_id, a[least(len(a), CAST(floor(0.5 * len(a)) AS BIGINT) + 1)] AS p50, a[least(len(a), CAST(floor(0.95 * len(a)) AS BIGINT) + 1)] AS p95, errors FROM q""",
    "e3_rolling_stats": f"""WITH {_E} SELECT event_id, round(avg(value) OVER w, 6) AS mean10, round(CASE WHEN count(value) OVER w < 2 THEN -1 ELSE stddev_samp(value) OVER w END, 3) AS std10 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS 9 PRECEDING)""",
    "e5_gap_detection": f"""WITH {_E}, p AS (SELECT DISTINCT user_id, t FROM e UNION SELECT DISTINCT user_id, 1704067200000000 FROM e UNION SELECT DISTINCT user_id, 1706745600000000 FROM e),
        l AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS from_t, t AS to_t FROM p) SELECT * FROM l WHERE to_t - from_t > {12 * HOUR}""",
    "e6_session_islands": f"""WITH {_E}, p AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM p)
        SELECT user_id, run, min(t) AS from_t, max(t) AS to_t, count(*) AS n, round(sum(value), 3) AS total FROM r GROUP BY 1, 2""",
    "e8_state_changes": f"""WITH {_E}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pt FROM e) SELECT event_id, pt AS from_type, event_type AS to_type FROM p WHERE pt <> event_type""",
    "e19_grid_resample": f"""WITH {_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT user_id, CAST(ceil(min(t) / {HOUR * 6}.0) AS BIGINT) AS a, CAST(floor(max(t) / {HOUR * 6}.0) AS BIGINT) AS z FROM v GROUP BY 1),
        g AS (SELECT user_id, unnest(range(a, z + 1)) * {6 * HOUR} AS t FROM b WHERE a <= z),
        m AS (SELECT g.user_id, g.t, v.value, row_number() OVER (PARTITION BY g.user_id, g.t ORDER BY v.t DESC, v.event_id DESC) AS r FROM g JOIN v ON v.user_id = g.user_id AND v.t <= g.t)
        SELECT user_id, t, round(value, 4) AS value FROM m WHERE r = 1""",
    "g6_interval_union": f"""WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) AS from_t, epoch_us(o_orderdate) + {45 * 24 * HOUR} AS to_t FROM orders),
        n AS (SELECT *, CASE WHEN from_t <= max(to_t) OVER (PARTITION BY o_custkey ORDER BY from_t, to_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
        r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY from_t, to_t ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT o_custkey, min(from_t) AS from_t, max(to_t) AS to_t FROM r GROUP BY o_custkey, run""",
    "t1_week_minutes": """SELECT CAST((isodow(ts) - 1) * 24 + hour(ts) AS BIGINT) AS week_hour, count(*) AS n FROM events GROUP BY 1""",
}
