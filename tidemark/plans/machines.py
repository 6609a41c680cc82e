"""Ordered state machines over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import stateful as st
from tidemark.plans.timeline import _E, events


def b12_thinning(spark, sf_dir):
    return st.batch(events(spark, sf_dir), "user_id", ["event_id", "t"], st.thin(0.95 / 43_200), (None,), "user_id long, event_id long", ["t", "event_id"])


def l5_chunks(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("line", F.col("l_linenumber").cast("long"))
    p = p.withColumn("k", F.col("l_orderkey") * 8 + F.col("line"))
    return st.batch(p, "l_suppkey", ["k", "l_quantity"], st.chunks(500.0), (0, 0.0), "l_suppkey long, k long, chunk long", ["k", "l_partkey", "l_extendedprice"])


def l5_odometry_chunks(spark, sf_dir):
    """Chunks of at most so far and so long, each of one channel."""
    return st.batch(events(spark, sf_dir), "user_id", ["event_id", "t", "event_type", "value"], st.odometry(120.0, 172_800_000_000), (0, 0.0, 0, None, None), "user_id long, event_id long, chunk long", ["t", "event_id"])


def l6_trips(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("speed", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")))
    return st.batch(e, "user_id", ["event_id", "t", "speed"], st.trips(3_600_000_000), (None, None, 0, None), "user_id long, start_t long, end_t long, reason string", ["t", "event_id"])


def l7_engine_states(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("rpm", F.col("value") * 10)
    return st.batch(e, "user_id", ["event_id", "rpm"], st.engine(), (None, None, 0, None, 0), "user_id long, event_id long, state string", ["t", "event_id"])


def l21_hysteresis(spark, sf_dir):
    return st.batch(events(spark, sf_dir), "user_id", ["event_id", "value"], st.hysteresis(80.0, 40.0), (False,), "user_id long, event_id long, warning boolean", ["t", "event_id"])


def d49_ewma(spark, sf_dir):
    got = st.batch(events(spark, sf_dir), "user_id", ["event_id", "t", "value"], st.ewma(43_200_000_000), (None, 0.0), "user_id long, event_id long, mean double", ["t", "event_id"])
    return got.select("event_id", F.round("mean", 6).alias("mean"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "bdl" and k[1:2].isdigit()}
_ROWS = f"{_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e)"
ORACLES = {
    "d49_ewma": f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, event_id, i, t, value AS m FROM n WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, t, k * m + (1 - k) * value FROM (SELECT n.*, r.m, exp(-(n.t - r.t) / 43200000000.0::DOUBLE) AS k FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
        SELECT event_id, round(m, 6) AS mean FROM r""",
    "l5_odometry_chunks": f"""WITH RECURSIVE {_ROWS}, r AS (SELECT user_id, event_id, i, t, event_type, CAST(0 AS BIGINT) AS chunk, value AS len, CAST(0 AS BIGINT) AS took FROM n WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, t, event_type, CASE WHEN shut THEN chunk + 1 ELSE chunk END, CASE WHEN shut THEN 0 ELSE len END + value, CASE WHEN shut THEN 0 ELSE took END + dt
        FROM (SELECT n.*, r.chunk, r.len, r.took, n.t - r.t AS dt, n.event_type <> r.event_type OR r.len >= 120 OR r.took >= 172800000000 AS shut FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)) SELECT user_id, event_id, chunk FROM r""",
    "l7_engine_states": f"""WITH RECURSIVE {_ROWS}, z AS (SELECT *, value * 10 AS rpm FROM n),
        s0 AS (SELECT DISTINCT user_id FROM z), r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS cand, 0 AS n, CAST(NULL AS DOUBLE) AS last, 0 AS rep, false AS said FROM s0
        UNION ALL SELECT user_id, i, event_id, CASE WHEN say THEN wish ELSE cur END, wish, n2, rpm, rep2, say FROM (
            SELECT *, coalesce(wish IS NOT NULL AND wish IS DISTINCT FROM cur AND (n2 >= 2 OR rep2 >= 2), false) AS say FROM (SELECT *, CASE WHEN wish IS NOT DISTINCT FROM cand THEN n + 1 ELSE 1 END AS n2 FROM (
            SELECT *, CASE WHEN rpm < 250 OR rep2 >= 2 THEN 'off' WHEN rpm >= 400 THEN 'running' ELSE cand END AS wish FROM (
            SELECT z.user_id, z.i, z.event_id, z.rpm, r.cur, r.cand, r.n, CASE WHEN z.rpm = r.last AND z.rpm >= 250 THEN r.rep + 1 ELSE 0 END AS rep2 FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)))))
        SELECT user_id, event_id, cur AS state FROM r WHERE said""",
    "l6_trips": f"""WITH RECURSIVE {_ROWS}, z AS (SELECT *, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS speed FROM n), s0 AS (SELECT DISTINCT user_id FROM z),
        r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS first, 0 AS n, CAST(NULL AS BIGINT) AS still, CAST(NULL AS BIGINT) AS s_out, CAST(NULL AS BIGINT) AS e_out FROM s0
        UNION ALL SELECT user_id, i, CASE WHEN speed > 0 AND b IS NULL AND n2 + 1 >= 2 THEN CASE WHEN n2 = 0 THEN t ELSE f END ELSE b END, CASE WHEN speed > 0 AND n2 = 0 THEN t ELSE f END, CASE WHEN speed > 0 THEN n2 + 1 ELSE 0 END,
            CASE WHEN speed > 0 THEN NULL WHEN s IS NULL THEN t ELSE s END, CASE WHEN over THEN began END, CASE WHEN over THEN still END
            FROM (SELECT *, CASE WHEN over THEN NULL ELSE began END AS b, CASE WHEN over THEN NULL ELSE first END AS f, CASE WHEN over THEN 0 ELSE n END AS n2, CASE WHEN over THEN NULL ELSE still END AS s
            FROM (SELECT z.user_id, z.i, z.t, z.speed, r.began, r.first, r.n, r.still, coalesce(r.began IS NOT NULL AND z.t - r.still >= 3600000000, false) AS over FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)))
        SELECT user_id, s_out AS start_t, e_out AS end_t, 'parked_timeout' AS reason FROM r WHERE s_out IS NOT NULL""",
    "b12_thinning": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1),
        r AS (SELECT user_id, event_id, t FROM f UNION ALL SELECT n.user_id, n.event_id, n.t FROM (SELECT r.user_id, (SELECT min((e.t, e.event_id)) FROM e WHERE e.user_id = r.user_id AND e.t - r.t >= 43200000000) AS m FROM r) x, (SELECT * FROM e) n WHERE n.user_id = x.user_id AND x.m IS NOT NULL AND (n.t, n.event_id) = x.m)
        SELECT user_id, event_id FROM r""",
    "l5_chunks": """WITH RECURSIVE p AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
        r AS (SELECT l_suppkey, k, i, CAST(0 AS BIGINT) AS chunk, q AS total FROM p WHERE i = 1
        UNION ALL SELECT p.l_suppkey, p.k, p.i, CASE WHEN r.total >= 500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.total >= 500 THEN p.q ELSE r.total + p.q END FROM r JOIN p ON p.l_suppkey = r.l_suppkey AND p.i = r.i + 1)
        SELECT l_suppkey, k, chunk FROM r""",
    "l21_hysteresis": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN value > 80 THEN true WHEN value <= 40 THEN false END AS s FROM events),
        f AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), false) AS warning FROM e),
        g AS (SELECT *, coalesce(lag(warning) OVER (PARTITION BY user_id ORDER BY t, event_id), false) AS was FROM f) SELECT user_id, event_id, warning FROM g WHERE warning <> was""",
}
