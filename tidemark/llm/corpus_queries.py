"""The operators applied to whole tables, each with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dedup, sharding
from tidemark.llm.registry import query, table

# Shingles as text, all pairs that share one, their overlap, and reachability over the links.
NEAR_DEDUP_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op4_near_dedup", NEAR_DEDUP_SQL)
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 percent shared five-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


# Each document word with its place; each window with the places of its words; hits by joining on the first
# word and comparing the rest.
DECONTAMINATE_SQL = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws]
        ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS w FROM bw),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
dwin AS (SELECT doc_id, i, n, ws[i:i + n - 1] AS w FROM (
           SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM dwin JOIN win USING (w)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document under 16 shards, its place there, and its shard under 17."""
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=16)
