"""Aggregations, verdicts, set operations and rankings on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.times import micros
from tidemark.operators import aggregate as ag
from tidemark.operators import search as se
from tidemark.operators import timeseries as ts


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d1_summary(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem")
    by = ["l_returnflag", "l_linestatus"]
    median = ag.quantiles(p, by, "l_extendedprice", {"median_price": ("linear", 0.5)})
    return p.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_extendedprice").alias("top_price")).join(median.withColumn("median_price", F.round("median_price", 4)), by)


def d13_line_fit(spark, sf_dir):
    got = ag.line_fit(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return got.select("l_suppkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r", 6).alias("r"))


def d14_best_field(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    got = ag.best_field(p, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 10)
    return got.select("l_returnflag", "field", F.round("r", 6).alias("r"))


def d28_grouped_totals(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return o.rollup("o_orderstatus", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.sum(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).otherwise(0.0)), 2).alias("without_low"))


def d29_verdicts(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    a = p.agg(F.min("y")).first()[0]
    return ag.verdict(p.filter(F.col("y") == a), p.filter(F.col("y") == a + 1), "l_suppkey", "l_quantity", 2.0)


def d30_largest_gap(spark, sf_dir):
    return ag.largest_gap(_t(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")


def d31_fisher(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    late = F.col("o_orderpriority").startswith("1")
    first = F.month("o_orderdate") <= 6
    n = o.groupBy("o_custkey").agg(*(F.count_if(c).cast("int").alias(k) for k, c in (("a", late & first), ("b", ~late & first), ("c", late & ~first), ("d", ~late & ~first))))
    return n.select("o_custkey", F.round(ag.fisher_more(*(F.col(k) for k in "abcd")), 6).alias("chance"))


def d34_circular_mean(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.round(ag.circular_mean(F.col("value") * 1.8), 4).alias("direction"))


def d34_agreed_direction(spark, sf_dir):
    """The direction of each user's events of a kind, where none is more than 60 degrees off the first."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", (F.col("value") * 1.8 + F.col("user_id") * 7).alias("angle"))
    got = ag.agreed_direction(e, ["user_id", "event_type"], ["ts", "event_id"], "angle", 60.0)
    return got.select("user_id", "event_type", F.round("direction", 4).alias("direction"))


def d36_merge_groups(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), (-best["k"]).alias("largest_order"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def d40_dictionary(spark, sf_dir):
    return se.dictionary(_t(spark, sf_dir, "part"), "p_type", "p_partkey", 100)


def d48_agreed_value(spark, sf_dir):
    return ag.agreed(_t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity", 0.5)


def d52_effective_size(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(ag.effective_size(F.col("o_totalprice")), 5).alias("size"))


def d53_softmax_weights(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").withColumn("x", F.col("c_acctbal") / 500)
    return ag.log_sum_exp(c, ["c_nationkey"], "x", "weight").select("c_custkey", F.round("weight", 6).alias("weight"))


def d57_checksum(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "o_orderkey", "o_custkey").cast("binary")), 1, 15), 16, 10).cast("long")
    return o.groupBy("o_orderstatus").agg(F.bit_xor(digest).alias("digest"), F.count("*").alias("n"))


def d11_longest_prefix(spark, sf_dir):
    table = spark.createDataFrame([("PROMO", "promo"), ("PROMO BRUSHED", "promo brushed"), ("S", "s"), ("STANDARD", "standard"), ("ECONOMY", "economy"), ("MEDIUM P", "mp")], "prefix string, make string")
    return ag.longest_prefix(_t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", table, "prefix", "make").select("p_partkey", "make")


def b17_retention(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (-micros(F.col("o_orderdate"))).alias("age"), (-F.col("o_orderkey")).alias("later"))
    return ts.running_sum(o, ["o_custkey"], ["age", "later"], F.col("o_totalprice"), "s", 365 * ts.BUCKET).filter("s > 500000").select("o_orderkey")


def f1_top_k(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


def f2_two_phase_top_k(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return se.two_phase_top(p, F.col("p_size"), F.round(F.col("p_retailprice") / F.col("p_size"), 6), "p_partkey", 250, 20).select("p_partkey", "score")


def f3_top_per_group(spark, sf_dir):
    return se.top_per_group(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


def f4_page_with_more(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(30).limit(11)
    w = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy()).alias("got")).filter("i <= 10").select("o_orderkey", (F.col("got") > 10).alias("more"))


def f10_argmin(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("poorest"))


def g1_union_best(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("name"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("name"))
    return a.unionByName(b).groupBy("k").agg(F.max(F.struct("score", "name")).alias("b")).select("k", "b.score", "b.name")


def g3_intersection(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem")
    return p.filter("l_returnflag = 'R'").select("l_partkey").intersect(p.filter("l_discount > 0.09").select("l_partkey"))


def g4_difference(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(_t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k", "left_anti")


def g5_containment(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("s"))
    return n.select("l_orderkey", (F.size(F.array_except(F.array(F.lit(1), F.lit(2), F.lit(3)), "s")) == 0).alias("has_all"))


def c15_semi_anti(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    big = _t(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(big, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "bcdfg" and k[1:2].isdigit()}
_Q = lambda a: f"{a}[least(len({a}), CAST(floor(0.5 * len({a})) AS BIGINT) + 1)]"
ORACLES = {
    "d1_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price, max(l_extendedprice) AS top_price FROM lineitem GROUP BY 1, 2",
    "d13_line_fit": "SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "d14_best_field": """WITH f AS (SELECT l_returnflag, 'l_quantity' AS field, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem GROUP BY 1) SELECT l_returnflag, field, round(r, 6) AS r FROM f QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(r) DESC, field) = 1""",
    "d28_grouped_totals": "SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice ELSE 0 END), 2) AS without_low FROM orders GROUP BY ROLLUP (o_orderstatus, CAST(year(o_orderdate) AS INTEGER))",
    "d29_verdicts": f"""WITH p AS (SELECT *, year(l_shipdate) AS y FROM lineitem), m AS (SELECT min(y) AS a FROM p),
        b AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q, max(l_quantity) AS w FROM p, m WHERE y = a GROUP BY 1), n AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS q, max(l_quantity) AS w FROM p, m WHERE y = a + 1 GROUP BY 1),
        j AS (SELECT coalesce(b.l_suppkey, n.l_suppkey) AS l_suppkey, {_Q("b.q")} AS bm, b.w AS bw, {_Q("n.q")} AS nm, n.w AS nw FROM b FULL JOIN n ON b.l_suppkey = n.l_suppkey)
        SELECT l_suppkey, bm AS before, nm AS now, CASE WHEN bm IS NULL THEN 'new' WHEN nm IS NULL THEN 'gone' WHEN nm > 1.5 * bm + 2 OR nw > 1.5 * bw + 5 THEN 'worse' WHEN bm > 1.5 * nm + 2 OR bw > 1.5 * nw + 5 THEN 'better' ELSE 'same' END AS verdict FROM j""",
    "d30_largest_gap": "WITH g AS (SELECT o_orderstatus, o_totalprice AS low, lead(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS high FROM orders) SELECT * FROM g WHERE high IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY low - high, low) = 1",
    "d31_fisher": """WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '1%' AND month(o_orderdate) <= 6) AS a, count(*) FILTER (o_orderpriority NOT LIKE '1%' AND month(o_orderdate) <= 6) AS b,
        count(*) FILTER (o_orderpriority LIKE '1%' AND month(o_orderdate) > 6) AS c, count(*) FILTER (o_orderpriority NOT LIKE '1%' AND month(o_orderdate) > 6) AS d FROM orders GROUP BY 1),
        k AS (SELECT *, unnest(range(c, least(a + c, c + d) + 1)) AS k FROM n)
        SELECT o_custkey, round(sum(CASE WHEN c + d - k <= b + d THEN exp(lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(c + d - k + 1) - lgamma(b + d - (c + d - k) + 1) - lgamma(a + b + c + d + 1) + lgamma(c + d + 1) + lgamma(a + b + 1)) ELSE 0 END), 6) AS chance FROM k GROUP BY 1""",
    "d34_circular_mean": "WITH d AS (SELECT user_id, degrees(atan2(sum(sin(radians(value * 1.8))), sum(cos(radians(value * 1.8))))) AS x FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN x < 0 THEN x + 360 ELSE x END, 4) AS direction FROM d",
    "d34_agreed_direction": """WITH e AS (SELECT user_id, event_type, value * 1.8::DOUBLE + user_id * 7 AS a, first_value(value * 1.8::DOUBLE + user_id * 7) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f FROM events WHERE value IS NOT NULL),
        m AS (SELECT user_id, event_type, degrees(atan2(sum(sin(radians(a))), sum(cos(radians(a))))) AS x, max(degrees(acos(greatest(-1, least(1, cos(radians(a - f))))))) AS off FROM e GROUP BY 1, 2) SELECT user_id, event_type, round(CASE WHEN off <= 60 THEN CASE WHEN x < 0 THEN x + 360 ELSE x END END, 4) AS direction FROM m""",
    "d36_merge_groups": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest_order, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1",
    "d40_dictionary": "WITH n AS (SELECT p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f, p_type) - 1 AS code FROM n) SELECT p_type, n, CASE WHEN code < 100 THEN code END AS code FROM r",
    "d48_agreed_value": "WITH w AS (SELECT l_partkey, l_returnflag AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, sum(w) AS total FROM w GROUP BY 1) SELECT l_partkey, CASE WHEN w >= 0.5 * total THEN v END AS agreed FROM w JOIN t USING (l_partkey) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, v DESC) = 1",
    "d52_effective_size": "SELECT o_custkey, round(sum(o_totalprice) * sum(o_totalprice) / sum(o_totalprice * o_totalprice), 5) AS size FROM orders GROUP BY 1",
    "d53_softmax_weights": "WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal / 500 AS x, max(c_acctbal / 500) OVER (PARTITION BY c_nationkey) AS m FROM customer) SELECT c_custkey, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY c_nationkey), 6) AS weight FROM m",
    "d11_longest_prefix": "WITH t(prefix, make) AS (VALUES ('PROMO', 'promo'), ('PROMO BRUSHED', 'promo brushed'), ('S', 's'), ('STANDARD', 'standard'), ('ECONOMY', 'economy'), ('MEDIUM P', 'mp')) SELECT p_partkey, max_by(make, length(prefix)) AS make FROM part LEFT JOIN t ON starts_with(p_type, prefix) GROUP BY 1",
    "b17_retention": "SELECT o_orderkey FROM orders QUALIFY sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) > 500000",
    "d57_checksum": "SELECT o_orderstatus, bit_xor(CAST('0x' || substr(md5(o_orderkey || '|' || o_custkey), 1, 15) AS BIGINT)) AS digest, count(*) AS n FROM orders GROUP BY 1",
    "f1_top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20",
    "f2_two_phase_top_k": "WITH c AS (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 250) SELECT p_partkey, round(p_retailprice / p_size, 6) AS score FROM c ORDER BY score DESC, p_partkey LIMIT 20",
    "f3_top_per_group": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 5",
    "f4_page_with_more": "SELECT o_orderkey, (SELECT count(*) FROM orders) > 40 AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30",
    "f10_argmin": "SELECT s_nationkey, arg_min(s_name, (s_acctbal, s_suppkey)) AS poorest FROM supplier GROUP BY 1",
    "g1_union_best": "WITH u AS (SELECT c_nationkey AS k, c_acctbal AS score, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_acctbal, s_name FROM supplier) SELECT k, score, name FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, name DESC) = 1",
    "g3_intersection": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09",
    "g4_difference": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "g5_containment": "SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (1, 2, 3)) = 3 AS has_all FROM lineitem GROUP BY 1",
    "c15_semi_anti": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) GROUP BY 1",
}
