"""Registered queries over the text tables: name -> job, and SQL where it can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appfacts.llm.chroma import align_recordings, media_of_vectors
from appfacts.llm.decontaminate import find_leaks
from appfacts.llm.html_text import extract_pages
from appfacts.llm.jaccard_trie import jaccard_components
from appfacts.llm.licenses import scan_licenses
from appfacts.llm.packing import pack_documents
from appfacts.llm.pieces import digest_documents
from appfacts.llm.source_audit import audit_sources
from appfacts.llm.suffix_dedup import digest_repeats
from appfacts.llm.tables import read
from appfacts.llm.toxicity import score_documents
from appfacts.llm.url_rules import BASE_RULES, WORD_RULES, judge_urls
from appfacts.llm.warc import BASE32, archive_pages
from appfacts.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document."""
    return scan_licenses(read(spark, sf_dir, "documents"))


@query
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 100 bytes that stood earlier."""
    return digest_repeats(read(spark, sf_dir, "documents"))


@query
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract_pages(read(spark, sf_dir, "pages"))


@query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the address of every page."""
    return judge_urls(read(spark, sf_dir, "pages"), BASE_RULES, WORD_RULES, keep=["page_id"])


ORACLES["op5_url_rules"] = f"""
WITH rules(verdict, rule) AS (VALUES {", ".join(str(r) for r in BASE_RULES)}),
split AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
sites AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_extract(rest, '^[^?#]*'), '(?s)/.*$') AS path
  FROM split
),
best AS (
  SELECT url, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM sites), rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY url
)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN regexp_matches(host || path, '(?is)(^|[^a-z0-9])({"|".join(w for _, w in WORD_RULES)})([^a-z0-9]|$)')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM sites LEFT JOIN best USING (url)
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of every document."""
    import public_tokenizers

    return pack_documents(
        read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the piece ids and of the decoded text of every document."""
    return digest_documents(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op9_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from all vectors: classes of equal ones, and what every fiftieth matches among all."""
    media = media_of_vectors(read(spark, sf_dir, "embeddings"))
    return align_recordings(media, F.col("media_id") % 50 == 0)


@query
def op10_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under links between similar sets of five-word shingles."""
    return jaccard_components(read(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the sixteen largest components, whitened."""
    return whiten(read(spark, sf_dir, "embeddings"))


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language depart from each other, and their most telling terms."""
    return audit_sources(read(spark, sf_dir, "documents"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op12_source_audit"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), {_LOWER}) AS text
  FROM documents
),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
) WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives written of all pages."""
    return archive_pages(read(spark, sf_dir, "pages"))


ORACLES["op13_archives"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, octet_length(payload) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN m USING (h)
"""
