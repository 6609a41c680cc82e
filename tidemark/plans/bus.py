"""Vehicle bus frames made of events: when they were sent, and where in them the speed stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import timeseries as ts
from tidemark.streaming.windows import reordered


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")


def e18_retimed(spark, sf_dir):
    """Frames that came in bursts, laid on the period of their id; breaks every 150 frames and at the end of each listening window."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 7).alias("bus"), F.col("event_type").alias("id"), F.col("event_id").alias("frame"), "us")
    e = ts.numbered(e, ["bus", "id"], ["us", "frame"], "k")
    e = e.withColumn("t", F.col("k") * 10_000 + F.col("frame") * 7919 % 60_000 + F.floor(F.col("k") / 150) * 700_000)
    windows = e.select("bus", (F.floor(F.col("t") / 1_300_000) * 1_300_000).alias("end_t")).distinct()
    got = fr.retimed(e, windows)
    return got.select("bus", "id", "frame", F.round(F.col("sent") / 100).cast("long").alias("sent"))


def _traffic(spark, sf_dir):
    """Polls and frames of a bus for each type of event: two polls an event, a second apart, and frames of two ids before and behind each.

    Id 1 has the speed in hundredths at bytes 2 and 3, id 2 that of two wheels at 0 and 4, low byte first, over a zero of 16.
    """
    e = ts.numbered(_events(spark, sf_dir).withColumn("bus", F.col("event_type")), ["bus"], ["us", "event_id"], "k")
    e = e.withColumn("at", F.col("k") * 10_000_000).withColumn("v", F.floor("value").cast("long") % 120)
    e = e.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("kph", F.when(F.col("v") == 0, 0).otherwise(F.col("v") + F.col("p") * (F.col("event_id") % 2)))
    polls = e.select("bus", (F.col("at") + F.col("p") * 1_000_000).alias("t"), "kph")
    f = e.withColumn("id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("d", F.explode(F.array(F.lit(-200_000), F.lit(200_000))))
    word = lambda x, little: (lambda hi, lo: [lo, hi] if little else [hi, lo])(F.floor(x / 256), x % 256)
    noise = [F.col("event_id") % 256, F.col("event_id") * 37 % 256, F.col("event_id") * 101 % 256, F.lit(7)]
    one = [*noise[:2], *word(F.col("kph") * 100, False), *noise]
    two = [*word(F.col("kph") * 64 + 16, True), *noise[:2], *word(F.col("kph") * 64 + 16 + F.when(F.col("kph") > 0, F.col("event_id") % 3).otherwise(0), True), *noise[2:]]
    data = F.when(F.col("id") == 1, F.array(*(c.cast("long") for c in one))).otherwise(F.array(*(c.cast("long") for c in two)))
    return polls, f.select("bus", "id", (F.col("at") + F.col("p") * 1_000_000 + F.col("d")).alias("t"), data.alias("data"))


def d14_speed_fields(spark, sf_dir):
    """Of every layout of two bytes in frames of two ids those that read as the polled speed."""
    polls, frames = _traffic(spark, sf_dir)
    got = fr.speed_fields(fr.speed_pairs(frames, polls), 20)
    return got.select("bus", "id", "byte", "little", "shift", "bits", F.round("kph_per_count", 7).alias("kph_per_count"), (F.round("zero", 3) + 0.0).alias("zero"), F.round("r", 7).alias("r"))


def d14_speed_message(spark, sf_dir):
    polls, frames = _traffic(spark, sf_dir)
    return fr.speed_message(fr.speed_fields(fr.speed_pairs(frames, polls), 20)).select("bus", "id", "fields", F.round("r", 7).alias("r"))


def l1_reordered(spark, sf_dir):
    """Readings of each user that come up to 0.7 s late, let out in order 0.3 s behind, 0.5 s once a bus frame was heard; place counts what came in time."""
    e = ts.numbered(_events(spark, sf_dir), ["user_id"], ["us", "event_id"], "k")
    e = e.select("user_id", "event_id", (F.col("k") * 100_000).alias("t"), F.when(F.col("event_id") % 50 == 3, "bus").otherwise("phone").alias("source"))
    e = e.withColumn("arrival", (F.col("t") + F.col("event_id") * 7919 % 700 * 1000) * 1000 + F.col("event_id") % 1000)
    got = reordered(e, "user_id", "arrival", "event_id", "t", "source", {"phone": 300_000, "bus": 500_000})
    return got.select("user_id", F.col("id").alias("event_id"), "t", "late")


QUERIES = {f.__name__: f for f in (l1_reordered, e18_retimed, d14_speed_fields, d14_speed_message)}
_FIELDS = """ev AS (SELECT event_id, event_type AS bus, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) * 10000000 AS at_us, CAST(floor(value) AS BIGINT) % 120 AS v FROM events),
    p AS (SELECT bus, event_id, at_us + p * 1000000 AS t, p, CASE WHEN v = 0 THEN 0 ELSE v + p * (event_id % 2) END AS kph FROM ev, (SELECT unnest([0, 1]) AS p)),
    q AS (SELECT *, coalesce(t - lag(t) OVER w <= 1200000 AND abs(kph - lag(kph) OVER w) <= 2, false) AS steady FROM p WINDOW w AS (PARTITION BY bus ORDER BY t)),
    w AS (SELECT bus, event_id, kph, steady, id, CASE WHEN id = 1 THEN [event_id % 256, event_id * 37 % 256, kph * 100 // 256, kph * 100 % 256, event_id % 256, event_id * 37 % 256, event_id * 101 % 256, 7]
        ELSE [(kph * 64 + 16) % 256, (kph * 64 + 16) // 256, event_id % 256, event_id * 37 % 256, (kph * 64 + 16 + CASE WHEN kph > 0 THEN event_id % 3 ELSE 0 END) % 256, (kph * 64 + 16 + CASE WHEN kph > 0 THEN event_id % 3 ELSE 0 END) // 256, event_id * 101 % 256, 7] END AS data FROM q, (SELECT unnest([1, 2]) AS id)),
    l AS (SELECT byte, little, shift, bits FROM (SELECT unnest(range(0, 7)) AS byte), (SELECT unnest([false, true]) AS little), (SELECT unnest(range(0, 5)) AS shift), (SELECT unnest([16, 15, 14, 13, 12, 11]) AS bits) WHERE shift + bits <= 16),
    y AS (SELECT bus, id, byte, little, shift, bits, CASE WHEN kph >= 5 AND steady THEN CAST(kph AS DOUBLE) END AS x, CASE WHEN kph = 0 THEN v END AS stand, CASE WHEN kph >= 5 AND steady THEN v END AS v
        FROM (SELECT *, CAST(((CASE WHEN little THEN data[byte + 1] + data[byte + 2] * 256 ELSE data[byte + 1] * 256 + data[byte + 2] END) >> shift) % (1 << bits) AS DOUBLE) AS v FROM w, l WHERE kph = 0 OR kph >= 5 AND steady)),
    g AS (SELECT bus, id, byte, little, shift, bits, count(x) AS n, covar_pop(x, v) / nullif(var_pop(x), 0) AS a, avg(v) - covar_pop(x, v) / nullif(var_pop(x), 0) * avg(x) AS b, CASE WHEN var_pop(v) > 0 THEN covar_pop(x, v) / sqrt(var_pop(x) * var_pop(v)) END AS r, avg(stand) AS stand, count(stand) AS stood FROM y GROUP BY ALL),
    ok AS (SELECT *, 1 / a AS per, CASE WHEN stood >= 3 THEN stand ELSE b END AS zero FROM g WHERE n >= 20 AND r >= 0.995 AND a > 0 AND 1 / a BETWEEN 0.002 AND 1 AND (stood < 3 OR abs(stand - b) / a <= 1.5)),
    nr AS (SELECT * FROM ok QUALIFY r >= max(r) OVER (PARTITION BY bus, id, byte, little) - 0.001),
    pl AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY bus, id, byte, little ORDER BY shift, bits DESC) = 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY bus, id ORDER BY round(r, 12) DESC, byte, little) AS k FROM pl),
    gr AS (SELECT bus, id, k, [byte] AS bytes, per AS first, true AS took FROM rk WHERE k = 1 UNION ALL SELECT rk.bus, rk.id, rk.k, CASE WHEN t.ok THEN list_append(gr.bytes, rk.byte) ELSE gr.bytes END, gr.first, t.ok
        FROM gr JOIN rk ON rk.bus = gr.bus AND rk.id = gr.id AND rk.k = gr.k + 1, LATERAL (SELECT len(list_filter(gr.bytes, lambda x: abs(x - rk.byte) < 2)) = 0 AND abs(rk.per / gr.first - 1) <= 0.03 AS ok) t),
    ff AS (SELECT rk.* FROM rk JOIN gr USING (bus, id, k) WHERE took)"""
ORACLES = {
    "l1_reordered": """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 100000 AS t, event_id % 50 = 3 AS bus FROM events),
        b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (t + event_id * 7919 % 700 * 1000) * 1000 + event_id % 1000, event_id) AS k FROM a),
        c AS (SELECT *, max(t) OVER w - CASE WHEN max(bus::INT) OVER w = 1 THEN 500000 ELSE 300000 END AS out_to FROM b WINDOW w AS (PARTITION BY user_id ORDER BY k)),
        d AS (SELECT *, max(out_to) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM c)
        SELECT user_id, event_id, t, coalesce(t <= gone, false) AS late FROM d""",
    "e18_retimed": """WITH RECURSIVE a AS (SELECT user_id % 7 AS bus, event_type AS id, event_id AS frame, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY ts, event_id) AS k FROM events),
        b AS (SELECT bus, id, frame, k * 10000 + frame * 7919 % 60000 + k // 150 * 700000 AS t FROM a), w AS (SELECT DISTINCT bus, t // 1300000 * 1300000 AS end_t FROM b),
        c AS (SELECT *, row_number() OVER o AS n, lag(t) OVER o AS p FROM b WINDOW o AS (PARTITION BY bus, id ORDER BY t, frame)),
        d AS (SELECT *, p IS NULL OR t - p > 500000 OR EXISTS (SELECT 1 FROM w WHERE w.bus = c.bus AND end_t >= p AND end_t < t) AS first FROM c),
        r AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY bus, id ORDER BY n) AS run FROM d),
        s AS (SELECT x.bus, x.id, x.n, y.run, count(*) AS m, covar_pop(y.n, y.t) * count(*) AS xy, var_pop(y.n) * count(*) AS xx FROM r x JOIN r y ON y.bus = x.bus AND y.id = x.id AND y.n BETWEEN x.n - 199 AND x.n GROUP BY ALL HAVING count(*) >= 2),
        u AS (SELECT bus, id, n, sum(xy) / sum(xx) AS period FROM s GROUP BY ALL HAVING sum(m) >= 20),
        v AS (SELECT r.*, last_value(CASE WHEN NOT first THEN period END IGNORE NULLS) OVER (PARTITION BY bus, id ORDER BY n ROWS UNBOUNDED PRECEDING) AS period FROM r LEFT JOIN u USING (bus, id, n)),
        z AS (SELECT bus, id, frame, n, CAST(t AS DOUBLE) AS sent FROM v WHERE n = 1 UNION ALL SELECT v.bus, v.id, v.frame, v.n, CASE WHEN first OR period IS NULL THEN t ELSE least(t, greatest(t - 300000, z.sent + period)) END FROM z JOIN v ON v.bus = z.bus AND v.id = z.id AND v.n = z.n + 1)
        SELECT bus, id, frame, CAST(round(sent / 100) AS BIGINT) AS sent FROM z""",
    "d14_speed_fields": f"WITH RECURSIVE {_FIELDS} SELECT bus, CAST(id AS INTEGER) AS id, CAST(byte AS INTEGER) AS byte, little, CAST(shift AS INTEGER) AS shift, CAST(bits AS INTEGER) AS bits, round(per, 7) AS kph_per_count, round(zero, 3) + 0.0 AS zero, round(r, 7) AS r FROM ff",
    "d14_speed_message": f"WITH RECURSIVE {_FIELDS}, m AS (SELECT bus, CAST(id AS INTEGER) AS id, count(*) AS fields, avg(r) AS r FROM ff GROUP BY 1, 2) SELECT bus, id, fields, round(r, 7) AS r FROM m QUALIFY row_number() OVER (PARTITION BY bus ORDER BY fields DESC, round(r, 9) DESC, id) = 1",
}
