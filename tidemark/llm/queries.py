"""The contract queries of this subpackage and, where SQL can say them, their texts for an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, langid, mixing, packing, periodic, pii, prefixes, quality, sharding, simhash, tokenfile, toxicity
from .common import cut, remove, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark, sf_dir):
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark, sf_dir):
    found = toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.to_json("passages").alias("passages"))


def op7_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_token_file(spark, sf_dir):
    folder = tokenfile.new_folder(spark)
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), folder)
    read = cut(tokenfile.digests(spark, folder), "token-digests")
    remove(spark, folder)
    return read


def op10_personal_data(spark, sf_dir):
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.find_runs(periodic.looped(_table(spark, sf_dir, "documents"))))


def op12_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_conversation_trie(spark, sf_dir):
    with scratch() as held:
        return held.keep(prefixes.trie(*prefixes.rebuilt(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_language_id, op3_decontamination, op4_simhash, op5_quality, op6_toxicity, op7_packing, op8_sharding, op9_token_file, op10_personal_data, op11_periodic_runs, op12_mixing, op13_conversation_trie)
}

#: Unsigned crc32 of an id as text, in SQL: bit by bit, with the polynomial of zlib.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(str_split(CAST({id} AS VARCHAR), ''), lambda c: ascii(c))), lambda c, b:
                       list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op3_decontamination": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM wins),
        places AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
                   FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS i FROM docs, sizes)),
        hits AS (SELECT doc_id, item_id, i, p.k FROM places p JOIN wins USING (win)),
        words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
        names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op8_sharding": """
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS bits FROM documents),
        p AS (SELECT i, doc_id, n_bytes, bits, depth, bits >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 61)) AS depth)),
        t AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS shard_bytes FROM p),
        f AS (SELECT * FROM t WHERE shard_bytes <= 33554432 OR depth = 60 QUALIFY row_number() OVER (PARTITION BY i ORDER BY depth) = 1)
        SELECT doc_id, n_bytes, left(lpad(bin(bits), 60, '0'), CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > 33554432 AS over_limit FROM f""",
    "op11_periodic_runs": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
                   CRC AS h FROM documents),
        e AS (SELECT *, len(own) AS n, h // 10 AS g FROM d),
        f AS (SELECT *, g % n AS a FROM e WHERE n > 0),
        w AS (SELECT doc_id, n, i, own[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word
              FROM f, unnest(range(0, n)) AS t(i)),
        same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
        isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM
                 (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
        left_over AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id),
        sums AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                 arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS best FROM runs GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)""".replace("CRC", CRC.format(id="doc_id")),
    "op13_conversation_trie": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
        k AS (SELECT *, CRC % 4 AS h FROM c),
        r AS (SELECT k.conv_id, list_concat(coalesce(list_slice(o.own, 1, k.h), []), list_slice(k.own, k.h + 1, len(k.own))) AS turns
              FROM k LEFT JOIN c o ON o.conv_id = k.conv_id - k.conv_id % 20),
        p AS (SELECT conv_id, turns, d, list_slice(turns, 1, d) AS path FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
        v AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                     len(regexp_extract_all(CASE WHEN d > 0 THEN path[d].text ELSE '' END, '[^\x20\x09-\x0D]+')) AS words,
                     string_agg(CASE WHEN len(turns) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
              FROM p GROUP BY path, d),
        kids AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
        n AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (path)),
        below AS (SELECT list_slice(n.path, 1, e) AS path, sum(words * (n_convs - 1)) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
                  FROM n, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
        SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
               sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n JOIN below USING (path) LEFT JOIN v up ON n.d > 0 AND up.path = list_slice(n.path, 1, n.d - 1)""".replace("CRC", CRC.format(id="conv_id")),
}
