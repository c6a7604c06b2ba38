"""The corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.bloom_lm import lm_scores
from spanveil.llm.common import shared_folder
from spanveil.llm.decontaminate import decontaminate
from spanveil.llm.digest_index import exact_dedup
from spanveil.llm.filter_audit import filter_audit
from spanveil.llm.hamming_search import top_k
from spanveil.llm.line_dedup import drop_frequent_lines
from spanveil.llm.mask_search import ranked_search
from spanveil.llm.mixing import mix
from spanveil.llm.order_minhash import near_duplicates
from spanveil.llm.token_counts import token_counts
from spanveil.llm.toxicity import toxicity_scores
from spanveil.llm.unit_dedup import drop_repeated_units
from spanveil.llm.warc import read_captures, resolved, write_archives

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# White space of the contracts, as DuckDB writes it.
DUCK_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    SPARK[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    lines = drop_frequent_lines(table(spark, folder, "documents"), min_docs=10, min_length=1)
    return lines.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {DUCK_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), archives)
    pages = resolved(read_captures(spark, archives))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM p
"""


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"), remainder("doc_id", 7) == 2)


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(
        table(spark, folder, "documents"), table(spark, folder, "labels"), remainder("doc_id", 5) == 0
    )


@query
def op5_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), k=5, least=0.8)
    return found.select("doc_id", "class_id", "is_first")


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_repeated_units(table(spark, folder, "documents"), unit="sentence", least_words=20)
    return found.select(
        "doc_id", "n_units", "n_removed", "removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op2_hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10, bits=64, segments=4)


SQL["op2_hamming_topk"] = """
WITH codes AS (
  SELECT vec_id, array_to_string([CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END FOR i IN range(1, 65)], '') AS code
  FROM embeddings
), near AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, hamming(q.code, c.code) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, c.code), c.vec_id) AS rank
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, neighbor_id, distance FROM near WHERE rank <= 10
"""


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


SQL["op11_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, bit)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s.step, bits[s.step] AS bit, coalesce(list_sum(bits[1:s.step - 1]), 0)::INTEGER AS gone
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) s
), counts AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & gone = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counts
"""


@query
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Half of the ids stand for what earlier runs have seen.
    return exact_dedup(
        table(spark, folder, "documents"),
        historical=lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0,
    )


SQL["op12_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS own
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY own) AS keep_id, count(*) OVER (PARTITION BY own) AS group_size,
       row_number() OVER (PARTITION BY own ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(own) AS text_sha256
FROM t
"""


@query
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


SQL["op13_lexical_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), asked AS (
  SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), whole AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0
), counts AS (
  SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf
  FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY r, doc_id, len(terms), term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole GROUP BY term, n_docs
), scores AS (
  SELECT q, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), whole
  GROUP BY q, item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
