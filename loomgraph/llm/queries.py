"""Queries pN_ of the operators on texts, with SQL by brute force for shared spans. It can't express encoding, mixing or
the trie join; see tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read
from . import mixing, spans, tokens, variants


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the name tables with the person or organisation that it names."""
    return variants.link_names(read(spark, d, "person_name"), read(spark, d, "aka_name"), read(spark, d, "company_name"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_entities(p1_links(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(read(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with the times that each occurs."""
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"))


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The mix with chances in proportion to the length of the documents."""
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_target"), weight="n_chars")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each source of the target really got."""
    return mixing.actual_shares(p7_mix(spark, d), read(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read(spark, d, "documents"))


def p8_amounts(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    docs = read(spark, d, "documents")
    return spans.shared_amounts(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p6_ids, p7_mix, p7_weighted, p7_shares, p8_found, p8_amounts)}
_WINDOWS = """
  SELECT doc_id, i, substr(text, i::BIGINT + 1, 300) AS w FROM (SELECT doc_id, text, unnest(range(length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)"""
_SPANS = f"""
WITH h AS MATERIALIZED (SELECT doc_id, i, md5_number(w) AS h FROM ({_WINDOWS})),
shared AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS new FROM h SEMI JOIN shared USING (h)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c)
SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) - min(i) + 300)::BIGINT AS span_len FROM g GROUP BY doc_id, g
"""
SQL: dict[str, str] = {
    "p8_found": _SPANS,
    "p8_amounts": f"SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(s, 0)::BIGINT AS shared_chars, coalesce(n, 0)::BIGINT AS n_spans FROM documents d LEFT JOIN (SELECT doc_id, sum(span_len) AS s, count(*) AS n FROM ({_SPANS}) GROUP BY 1) x ON x.doc_id = d.doc_id",
}
