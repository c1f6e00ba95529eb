"""The thin queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, extract, linededup, lm, packing, quality, records, resample, secrets, simhash, spans, trie, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    warc.write_warc(common.table(spark, sf_dir, "pages"), path)
    found = warc.read_warc(spark, path, payloads=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).drop("text")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "records")
    records.write_records(
        common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1
    )
    index = records.write_index(spark, path, common.shared_dir(spark, "records-index"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"), path="source")


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(common.table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents")).drop("votes")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).drop("text")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(common.table(spark, sf_dir, "conversations"), group=5)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(common.table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_decontaminate,
        op3_pack,
        op4_simhash,
        op5_records,
        op6_lm,
        op7_secrets,
        op8_spans,
        op9_quality,
        op10_lines,
        op11_trie,
        op12_resample,
        op13_extract,
        pipeline,
    )
}

_ORACLE_2 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS p
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM pattern) WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, place.size, item_id FROM place JOIN pattern USING (p, size)),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_ORACLE_1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x,
         min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
g AS (
  SELECT *, [('0x' || substr(x, 1 + 10 * i, 10))::BIGINT FOR i IN range(4)] AS n FROM d)
SELECT page_id, payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((v >> (35 - 5 * k)) & 31)::INT, 1) FOR k IN range(8)], '') FOR v IN n], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

_ORACLE_10 = r"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, i, ls[i] AS raw,
    translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM doc)),
shared AS (
  SELECT k, min(doc_id) AS owner FROM line WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT line.doc_id, i, raw, (owner IS NOT NULL AND owner <> line.doc_id) AS gone
  FROM line LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ORACLE_11 = """
WITH bits AS (
  SELECT list(c ORDER BY b) AS tbl FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS b))),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda s, x: xor(s >> 8, tbl[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), bits),
r AS (
  SELECT c.conv_id, pos AS d, m, b FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h
  UNION ALL
  SELECT c.conv_id, pos - c.h + least(c.h, coalesce(o.n, 0)), m, b
  FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c AS o ON o.conv_id = c.base WHERE pos > c.h),
p AS (
  SELECT conv_id, d, b, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(b) AS cost,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM e GROUP BY k, d),
child AS (SELECT substr(k, 1, 32 * (d - 1)::INT) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
up AS (
  SELECT substr(k, 1, 32 * i::INT) AS k, sum(leaf) AS leaves, sum(cost) AS cost
  FROM (SELECT node.k, cost, (child.k IS NULL)::BIGINT AS leaf, unnest(range(0, d + 1)) AS i
        FROM node LEFT JOIN child USING (k)) GROUP BY 1)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs,
  coalesce(child.n, 0) AS n_children, up.leaves::BIGINT AS n_leaves, up.cost::BIGINT AS saved_tokens,
  sha256(coalesce(node.ids, '')) AS ends_sha256
FROM node JOIN up USING (k) LEFT JOIN child USING (k)
LEFT JOIN node AS parent ON node.d > 0 AND parent.k = substr(node.k, 1, 32 * (node.d - 1)::INT)
"""

ORACLES: dict[str, str] = {"op1_warc": _ORACLE_1, "op2_decontaminate": _ORACLE_2, "op10_lines": _ORACLE_10, "op11_trie": _ORACLE_11}
