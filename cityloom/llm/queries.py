"""The registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_duplicates
from .jaccard_join import similarity_classes
from .language_id import language_id
from .line_quality import judge, learn
from .mixing import mixed_sizes
from .ngram_lm import language_model_scores
from .prefix_trie import prefix_trie
from .secret_scan import digest, find_secrets
from .secret_scan import learn as learn_secrets
from .sentence_pieces import default_model, encode, read_model
from .simhash import simhash_components
from .span_dedup import remove_repeated_spans
from .token_alignment import align
from .warc import capture_histories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


@query()
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(documents(spark, folder)).select(
        "doc_id", "class_id", "class_size", "links", F.col("is_first").alias("kept"))


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(documents(spark, folder))


@query(r"""
WITH sized AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS spot, CAST(len(regexp_extract_all(
           coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, cap / w AS full_at FROM s),
g AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS caps, coalesce(sum(w) OVER p, 0) AS ws FROM f
      WINDOW p AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(w) AS tw FROM s),
l AS (SELECT coalesce(min(full_at_level.lv), 'infinity'::DOUBLE) AS lv FROM (
      SELECT (budget - caps) / (tw - ws) AS lv FROM g, b WHERE (budget - caps) / (tw - ws) <= full_at
      ORDER BY full_at, source NULLS LAST LIMIT 1) AS full_at_level),
t AS (SELECT source, source_size, least(cap, lv * w) AS target FROM f, l),
q AS (SELECT sized.*, source_size, target, sum(size) OVER (PARTITION BY sized.source ORDER BY spot, doc_id
             ROWS UNBOUNDED PRECEDING) - size AS start0
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, start0 + turn * source_size AS start, least(size, ceil(target) - (start0 + turn * source_size)) AS words,
             (start0 + turn * source_size + size) / target AS finish
      FROM q, (SELECT unnest([0, 1]) AS turn) WHERE size > 0 AND start0 + turn * source_size < ceil(target)),
r AS (SELECT doc_id, greatest(least(words, floor(budget) - sum(words) OVER (ORDER BY finish, source NULLS LAST, spot,
             doc_id, turn ROWS UNBOUNDED PRECEDING) + words), 0) AS words FROM e, b)
SELECT q.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN (SELECT doc_id, sum(words) AS taken FROM r GROUP BY doc_id) AS k USING (doc_id)
""")
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_sizes(documents(spark, folder))


@query()
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded; the digest of the ids stands for them."""
    coded = encode(documents(spark, folder), read_model(default_model()), check=True)
    return coded.select("doc_id", "n_tokens", "n_bytes", "round_trip", F.xxhash64("ids").alias("ids_hash"))


@query()
def op10_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_spans(documents(spark, folder), every_run=True).select(
        "doc_id", "n_sentences", "n_removed", (F.col("n_removed") == 0).alias("untouched"), "removed", "text")


@query()
def op9_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return judge(docs, learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))).drop("key")


@query()
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return digest(find_secrets(docs, learn_secrets(docs)))


@query("""
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM (SELECT page_id, body, CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS keep
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
""")
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return capture_histories(spark.read.parquet(f"{folder}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model_scores(documents(spark, folder))


@query("""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                  ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1),
             lambda i: ascii(substr(name, CAST(i AS INTEGER), 1))::BIGINT)),
             lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)),
             lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
m AS (SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER w AS path, strlen(text) AS size
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
      UNION ALL SELECT conv_id, 0, [], 0 FROM c),
k AS (SELECT *, dense_rank() OVER (ORDER BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM k GROUP BY node, depth),
p AS (SELECT n.*, up.node AS parent FROM n LEFT JOIN k AS up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN
             (SELECT parent AS node, count(*) AS n_children FROM p GROUP BY parent) USING (node)),
s AS (SELECT k.node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
      FROM q JOIN k ON k.conv_id = q.conv_id AND k.depth <= q.depth GROUP BY k.node)
SELECT q.conv_id, q.depth, up.conv_id AS parent_conv_id, q.n_convs, q.n_children, n_leaves, saved_tokens, q.ends_sha256
FROM q JOIN s USING (node) LEFT JOIN n AS up ON up.node = q.parent
""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"), family=5)


@query()
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(documents(spark, folder))


@query()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(documents(spark, folder)).withColumnRenamed("groups", "groups_sha256")
