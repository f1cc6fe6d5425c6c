"""The registered queries of this subpackage: thin digests over the operators' outputs."""

from __future__ import annotations

from functools import wraps

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_path
from ..workloads.registry import Query
from . import (
    alignment,
    context_tree,
    divergence,
    lattice,
    media,
    mixing,
    packing,
    quality,
    relative_lz,
    simhash,
    suffix_dedup,
    token_files,
    warc,
)
from .ship import ship

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents"))


@query
def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a media container, its index and its payload read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media.with_index(media.with_media(docs, "text"))
    payload, stored = F.col("track.payload"), F.col("media")
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length(stored).cast("long").alias("media_bytes"),
        F.sha2(stored, 256).alias("media_sha256"),
        media.feature().alias("feature"),
    )


ORACLES["op3_warc_bundles"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
d AS (
  SELECT page_id, payload_bytes, sha, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(sha, 1 + i // 8 * 10, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '')
    AS payload_digest, min(page_id) OVER (PARTITION BY sha) AS first FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""


@query
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written from all pages, read back through their index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = warc.write_archives(pages, shared_path(spark, "archives"))
    return warc.read_archives(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the strings that earlier documents hold, as digests."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate(spans["length"], F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written from all documents, read back through their index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    index = token_files.write_token_files(docs, shared_path(spark, "tokens"), vocabulary, end_id=2)
    return token_files.read_token_files(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    featured = cut_lineage(quality.with_features(docs).select("doc_id", "features"))
    return quality.classify(featured, quality.learn(featured, table(spark, sf_dir, "labels")))


ORACLES["op9_embedding_groups"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x)
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, r.component_id,
  r.vec_id = r.component_id AS kept
FROM roots r
"""


@query
def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.cosine_groups(table(spark, sf_dir, "embeddings"))


@query
def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, vocabulary, end_id=2).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of all texts, and how common the links are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabularies = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    groups = F.col("groups")
    digest = F.when(groups == "", "").otherwise(F.sha2(groups, 256)).alias("groups_sha256")
    aligned = alignment.align(docs, *vocabularies)
    aligned = cut_lineage(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return alignment.score_links(aligned, alignment.link_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, c, CAST(1 + 1000000000::HUGEINT * (c + 5)
    // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p
  FROM dense),
overall AS (
  SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(c) + 5)
    // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM dense GROUP BY lang, term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a
  JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN apart a ON a.lang = g.lang AND a.source = g.source AND a.item = o.source),
terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, p - q AS value
  FROM shares s JOIN overall o ON o.lang = s.lang AND o.term = s.term WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_repeated_passages"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM docs),
windows AS (
  SELECT r, doc_id, i, md5(string_agg(w, ' ') OVER later) AS s FROM words
  WINDOW later AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
  QUALIFY count(*) OVER later = 50),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
hits AS (SELECT r, i FROM windows JOIN firsts USING (s) WHERE doc_id > first),
marked AS (
  SELECT r, i, w, max(h.i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN hits h USING (r, i))
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, count(m.i) FILTER (m.gone) AS n_removed,
  sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.i) FILTER (NOT m.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN marked m USING (r) GROUP BY d.r, d.doc_id, d.ws
"""


@query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold, as digests."""
    rows = relative_lz.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.col("spans")["length"], F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
