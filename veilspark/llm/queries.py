"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .collisions import near_vectors
from .common import documents, held_out, scratch_path
from .crf import toxicity
from .ctw import score_texts
from .decision_list import quality_rules
from .kneser_ney import quality
from .pareto import pareto_mix, word_count
from .sanitise import find_private, span_text
from .sharding import shard_documents
from .simhash import near_duplicates
from .tiling import contaminated
from .trie import conversation_trie
from .warc import dedup_plan, read_warc, write_warc


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(dedup_plan(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    records = read_warc(spark, path, payloads=False).where("kind = 'record'")
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "gaps_before")


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response IS NOT DISTINCT FROM page_id THEN NULL ELSE response END AS refers_to,
       0::BIGINT AS gaps_before
FROM r
"""


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(documents(spark, sf_dir), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2)).drop("bits_per_byte")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_text=False).select("doc_id", "lang", "words", "perplexity", "surprise", "threshold", "kept")


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    other = held_out(F.col("doc_id"), 3, 1)
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~other).select("doc_id", other.alias("held_out"), "score", "predicted", "spans")


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_private(documents(spark, sf_dir))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select("doc_id", number(0).alias("n_email"), number(1).alias("n_ip"), number(2).alias("n_card"), number(3).alias("n_phone"), F.sha2(span_text(F.col("spans"), 3), 256).alias("base_sha256"), span_text(F.col("spans"), 4).alias("spans"), number(4).alias("n_terms"), F.md5("sanitised").alias("sanitised_md5"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(documents(spark, sf_dir).withColumn("size", word_count(F.col("text"))))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d0 AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS u FROM documents),
d AS (SELECT *, length(bin(size))::BIGINT AS cls, (u + 0.5) / 4503599627370496::DOUBLE AS x FROM d0),
s AS (SELECT source, sum(size)::DOUBLE AS n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * n / w AS stop,
             (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, n, least(3 * n, w * (SELECT max(level) FROM c WHERE level <= stop)) AS target FROM c),
k AS (SELECT source, cls, sum(size)::DOUBLE AS cn FROM d GROUP BY ALL),
k1 AS (SELECT k.*, n, target, (target - coalesce(sum(cn * 3) OVER (PARTITION BY k.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / nullif(sum(cls * cn) OVER (PARTITION BY k.source ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lv
       FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
k2 AS (SELECT *, CASE WHEN n > 0 THEN least(3.0::DOUBLE, coalesce(max(CASE WHEN lv <= 3.0::DOUBLE / cls THEN lv END) OVER (PARTITION BY source), 3.0::DOUBLE) * cls) ELSE 0 END AS r FROM k1),
r AS (SELECT d.*, n, target, floor(r) AS whole, r - floor(r) AS p FROM d JOIN k2 ON d.source IS NOT DISTINCT FROM k2.source AND d.cls = k2.cls),
v AS (SELECT *, CASE WHEN p > 0 THEN (x / (1 - x)) / (p / (1 - p)) END AS q, sum(p * size) OVER (PARTITION BY source) AS rest FROM r),
f AS (SELECT *, floor(q / (1 + q) * 4503599627370496::DOUBLE)::BIGINT AS place FROM v),
z AS (SELECT *, sum(CASE WHEN place IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY place NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY source, place) AS own FROM f)
SELECT doc_id, size, n::BIGINT AS source_size, target, (size * (whole + CASE WHEN place IS NOT NULL AND 2 * rest >= 2 * upto - own THEN 1 ELSE 0 END))::BIGINT AS taken FROM z
"""


def op10_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return pairs.select("doc_id", "item_id", "coverage", F.lit(True).alias("contaminated"))


def op11_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)) AS fine FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) > 0 AND list_bool_and(fine) AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, min(b) AS component_id, min(b) = vec_id AS kept FROM embeddings JOIN r ON r.a = vec_id GROUP BY vec_id
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of a number's decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
OP13_SQL = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS l FROM t GROUP BY c),
h AS (SELECT c, l, ({_CRC} % 4)::INT AS h FROM own),
p AS (SELECT h.c, CASE WHEN b.l IS NULL THEN h.l[h + 1:] ELSE list_concat(b.l[1:h], h.l[h + 1:]) END AS p FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
x AS (SELECT c, len(p) AS size, unnest(range(len(p) + 1)) AS d, p FROM p),
n AS (SELECT p[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^ 	-
]+')) END AS words FROM x GROUP BY k, d),
m AS (SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n b WHERE b.d = n.d + 1 AND b.k[1:n.d] = n.k) AS n_children FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.k = n.k[1:n.d - 1]),
s AS (SELECT k[1:u] AS k, u AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS u FROM m) GROUP BY 1, 2)
SELECT conv_id, m.d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM m JOIN s ON m.d = s.d AND m.k = s.k
"""


QUERIES = {f.__name__: f for f in (op1_warc_salvage, op2_minimax_shards, op3_context_tree, op4_kneser_ney, op5_crf_toxicity, op6_decision_list, op7_sanitise, op8_simhash, op9_pareto_mix, op10_greedy_tiling, op11_collision_counting, op12_token_alignment, op13_prefix_trie)}
ORACLES = {"op1_warc_salvage": OP1_SQL, "op9_pareto_mix": OP9_SQL, "op11_collision_counting": OP11_SQL, "op13_prefix_trie": OP13_SQL}
