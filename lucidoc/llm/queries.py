"""The operators as thin queries over the whole `documents` table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hilbert, near_dup, packing, pii, quality_model, quality_rules, secret_scan, token_files, word_pieces
from .common import load
from .encoding import vocabulary

VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.token_counts(load(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(load(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_model.scored(docs, quality_model.train(docs, load(spark, sf_dir, "labels")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(load(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(load(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(load(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_hilbert_shards": op2_hilbert_shards,
    "op3_quality_model": op3_quality_model,
    "op4_token_files": op4_token_files,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
}

#: Fixed values of op7 in SQL: words are runs of 0-9, a-z and anything beyond ASCII.
OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
        FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
pos AS (SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS s
        FROM d, lens, unnest(range(1, greatest(len(w) - l + 1, 0) + 1)) AS u(i)),
occ AS (SELECT r, i, l, item_id FROM pos JOIN win USING (l, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + l)) AS v(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS h
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

#: Sets of 4-word shingles, all pairs that share one, links, and reachability.
OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, r FROM reach JOIN edges ON x = reach.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) USING (doc_id)
"""

#: The measures, and the rules as one condition.
OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 3)) AS u(p) GROUP BY 1),
l AS (SELECT r, count(*) AS n, count(DISTINCT x) AS k FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n - l.k, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks, coalesce(l.n, 0) AS n_lines
      FROM d LEFT JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * marks > 3 * n_words
       OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""

ORACLE_SQL: dict[str, str] = {
    "op5_near_duplicates": OP5,
    "op7_decontamination": OP7,
    "op9_quality_rules": OP9,
}
