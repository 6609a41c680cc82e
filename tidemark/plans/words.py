"""Search, folding and parsing over part names, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import conv, text
from tidemark.operators import search as se
from tidemark.operators import tables
from tidemark.sources import html


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark, sf_dir):
    """The documents' index, written once and read by every search of the session."""
    docs = _t(spark, sf_dir, "documents")
    return tables.stored(docs, f"index {sf_dir}", lambda: se.laid_out(se.postings(docs, "doc_id", "text")))


def s1_fold_tokens(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def s3_name_key(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.name_key(F.col("p_type"), ("standard", "small")).alias("name_key"))


def s5_typo_budget(spark, sf_dir):
    i = se.postings(_t(spark, sf_dir, "part"), "p_partkey", "p_type").select("token").distinct()
    return i.select("token", text.typo_budget(F.col("token")).alias("budget"))


def s6_typo_match(spark, sf_dir):
    i = tables.stored(_t(spark, sf_dir, "documents"), f"vocabulary {sf_dir}", lambda: _index(spark, sf_dir).select("token").distinct())
    words = spark.createDataFrame([("thta",), ("wiht",), ("disgustign",), ("worhtless",), ("form",), ("patehtic",), ("teh",), ("clwon",)], "word string")
    return se.near_tokens(i, words)


def s7_prefix_range(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.filter((F.col("token") >= "tha") & (F.col("token") < "thb")).groupBy("token").agg(F.count("*").alias("n"))


def s8_coordinates(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    lat, lon = F.format_string("%.4f", F.col("c_acctbal") / 100), F.format_string("%.2f", ((F.col("c_custkey") % 360) - 180).cast("double"))
    p = text.coordinates(F.concat(lat, F.lit(", "), lon))
    return c.select("c_custkey", F.round(p["lat"], 4).alias("lat"), F.round(p["lon"], 4).alias("lon"))


def s11_road_km(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    s = F.concat(F.col("o_custkey").cast("string"), F.lit("+"), (F.col("o_orderkey") % 1000).cast("string"))
    return o.select("o_orderkey", F.round(text.road_km(s), 3).alias("km"))


def b6_speed_limits(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    tag = F.concat((F.col("p_size") * 5).cast("string"), F.when(F.col("p_partkey") % 3 == 0, " mph").when(F.col("p_partkey") % 7 == 0, " knots").otherwise(""))
    return p.select("p_partkey", text.speed_limit(tag).alias("limit"))


def m18_bit_fields(spark, sf_dir):
    b = text.hex_bytes(F.md5(F.col("o_orderkey").cast("string")))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", b.alias("b"))
    return o.select("o_orderkey", text.bit_field(F.col("b"), 0, 16, big=True).alias("be16"), text.bit_field(F.col("b"), 16, 12).alias("le12"), text.bit_field(F.col("b"), 40, 8, signed=True).alias("s8"))


def d39_inverted_index(spark, sf_dir):
    i = se.postings(_t(spark, sf_dir, "part"), "p_partkey", "p_name")
    return i.groupBy("token").agg(F.count("*").alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


def c25_conjunctive_match(spark, sf_dir):
    i = _index(spark, sf_dir)
    return se.match_all(i, ["that", "from", "tio"], "doc_id", prefix=True)


def c22_subset_words(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = spark.createDataFrame([(1, "widget cold"), (2, "small ring"), (3, "anvil")], "q int, text string")
    need = asked.select("q", F.explode(text.ascii_tokens(F.col("text"))).alias("token"), F.size(text.ascii_tokens(F.col("text"))).alias("need"))
    hits = se.postings(p, "p_partkey", "p_name").join(F.broadcast(need), "token").groupBy("q", "p_partkey", "need").agg(F.count("*").alias("n"))
    return hits.filter("n = need").select("q", "p_partkey")


def f5_natural_order(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat((F.col("s_suppkey") % 17).cast("string"), F.lit("A"), F.col("s_nationkey").cast("string")).alias("house"))
    a, b = text.natural_order(F.col("house"))
    got = tables.ordinal(s.withColumns({"number": a, "rest": b}), F.col("number"), ["rest", "s_suppkey"], "place")
    return got.select("s_suppkey", "place")


def r1_code_names(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", conv.code_name(F.col("p_size"), {1: "one", 2: "two", 7: "seven"}).alias("name"))


def r3_zipped_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ">")
    return c.select("conv_id", F.size("t").cast("long").alias("turns"), roles.alias("roles"), F.array_max(F.transform("t", lambda x: F.length(x["text"]))).cast("long").alias("longest"))


def r7_json_props(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def a15_html_tables(spark, sf_dir):
    """Pages with a table of each customer's orders under a line of text."""
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderpriority"), F.lit("<br> "), F.col("o_orderstatus"), F.lit("&amp;</td></tr>"))
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda s: s["r"]), "\n").alias("rows"))
    page = F.concat(F.lit("<h1>List</h1><p>Orders of "), F.col("c_name"), F.lit("</p><table><tr><th>key<th>what</tr>"), F.col("rows"), F.lit("</table><p>end"))
    p = _t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", page.alias("html"))
    return html.tables(p, "c_custkey", "html").filter("row > 0").withColumn("cells", F.array_join("cells", ";"))


def a15_page_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.size(html.links(F.col("html"))).cast("long").alias("links"))


def a30_catalog(spark, sf_dir):
    d = _t(spark, sf_dir, "pages")
    return d.select("page_id", F.octet_length("html").cast("long").alias("size"), F.md5(F.col("html").cast("binary")).alias("md5"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "abcdfmrs" and k[1:2].isdigit()}
_TOK = "SELECT DISTINCT {key}, unnest(regexp_extract_all(replace(replace(replace(strip_accents(replace(replace(replace(replace(lower({text}), chr(39), ''), '’', ''), 'ʼ', ''), '`', '')), 'ye', 'ie'), 'yu', 'iu'), 'ya', 'ia'), '[a-z0-9]+')) AS token FROM {table}"
_DOC, _PART = _TOK.format(key="doc_id", text="text", table="documents"), _TOK.format(key="p_partkey", text="{}", table="part")
_BUD = "CASE WHEN regexp_matches({0}, '[0-9]') THEN 0 WHEN length({0}) >= 8 THEN 2 WHEN length({0}) >= 4 THEN 1 ELSE 0 END"
ORACLES = {
    "s1_fold_tokens": "WITH d AS (SELECT doc_id, regexp_extract_all(replace(replace(replace(strip_accents(replace(replace(replace(replace(lower(text), chr(39), ''), '’', ''), 'ʼ', ''), '`', '')), 'ye', 'ie'), 'yu', 'iu'), 'ya', 'ia'), '[a-z0-9]+') AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM d",
    "s3_name_key": "SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda x: x NOT IN ('standard', 'small')), ' ') AS name_key FROM part",
    "s5_typo_budget": f"WITH t AS ({_PART.format('p_type')}) SELECT DISTINCT token, CAST({_BUD.format('token')} AS INTEGER) AS budget FROM t",
    "s6_typo_match": f"""WITH t AS (SELECT DISTINCT token FROM ({_DOC})), w(word) AS (VALUES ('thta'), ('wiht'), ('disgustign'), ('worhtless'), ('form'), ('patehtic'), ('teh'), ('clwon')), b AS (SELECT word, {_BUD.format('word')} AS budget FROM w)
        SELECT word, token, CAST(damerau_levenshtein(word, token) AS INTEGER) AS distance FROM b JOIN t ON left(word, 1) = left(token, 1) AND abs(length(word) - length(token)) <= budget AND damerau_levenshtein(word, token) <= budget""",
    "s7_prefix_range": f"SELECT token, count(*) AS n FROM ({_DOC}) WHERE token >= 'tha' AND token < 'thb' GROUP BY 1",
    "s8_coordinates": "WITH c AS (SELECT c_custkey, round(c_acctbal / 100, 4) AS lat, CAST((c_custkey % 360) - 180 AS DOUBLE) AS lon FROM customer) SELECT c_custkey, CASE WHEN abs(lat) <= 90 THEN lat WHEN abs(lon) <= 90 AND abs(lat) <= 180 THEN lon END AS lat, CASE WHEN abs(lat) <= 90 THEN lon WHEN abs(lon) <= 90 AND abs(lat) <= 180 THEN lat END AS lon FROM c",
    "s11_road_km": "SELECT o_orderkey, round(CAST(o_custkey || '.' || rpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS DOUBLE), 3) AS km FROM orders",
    "b6_speed_limits": "WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(round_even(p_size * 5 * 1.609344, 0) AS INTEGER) WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 5 END AS v FROM part) SELECT p_partkey, CASE WHEN v BETWEEN 1 AND 250 THEN v END AS \"limit\" FROM v",
    "m18_bit_fields": """WITH b AS (SELECT o_orderkey, list_transform(range(0, 6), lambda i: CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM orders)
        SELECT o_orderkey, b[1] * 256 + b[2] AS be16, (b[3] + b[4] * 256) % 4096 AS le12, CASE WHEN b[6] > 127 THEN b[6] - 256 ELSE b[6] END AS s8 FROM b""",
    "d39_inverted_index": f"SELECT token, count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM ({_PART.format('p_name')}) GROUP BY 1",
    "c25_conjunctive_match": f"SELECT doc_id FROM ({_DOC}) GROUP BY 1 HAVING bool_or(token = 'that') AND bool_or(token = 'from') AND bool_or(token LIKE 'tio%')",
    "c22_subset_words": "WITH q(q, w) AS (VALUES (1, ['widget', 'cold']), (2, ['small', 'ring']), (3, ['anvil'])) SELECT q, p_partkey FROM part, q WHERE list_has_all(regexp_extract_all(lower(p_name), '[a-z0-9]+'), w)",
    "f5_natural_order": "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 17, lower(CAST(s_suppkey % 17 AS VARCHAR) || 'A' || CAST(s_nationkey AS VARCHAR)), s_suppkey) AS place FROM supplier",
    "r1_code_names": "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 7 THEN 'seven' ELSE 'code_' || p_size END AS name FROM part",
    "r3_zipped_turns": "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, max(length(text)) AS longest FROM conversations GROUP BY 1",
    "r7_json_props": "SELECT event_type, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k, count(props->>'k') AS n FROM events GROUP BY 1",
    "a15_html_tables": """SELECT c_custkey, CAST(0 AS INTEGER) AS "table", CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS INTEGER) AS row, 'List Orders of ' || c_name AS heading, o_orderkey || ';' || o_orderpriority || ' | ' || o_orderstatus || '&' AS cells FROM customer JOIN orders ON o_custkey = c_custkey""",
    "a15_page_links": """SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["\'']([^"\'']+)["\'']', 1)) AS BIGINT) AS links FROM pages""",
    "a30_catalog": "SELECT page_id, strlen(html) AS size, md5(html) AS md5, sha256(html) AS sha256 FROM pages",
}
