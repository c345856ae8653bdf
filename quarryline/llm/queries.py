"""Registered queries of the corpus operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontamination, exact_dedup, html_text, langid, line_dedup, ngram_join, packing, pii, secrets, toxicity
from quarryline.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans and all spans, as ``secrets.scan`` finds them; nulls, empty and long texts, repeats and empty tables as there."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents by whole text, as ``exact_dedup.exact_dedup`` groups them; nulls, ties, repeats and empty tables as there."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, as ``html_text.extract_pages`` lays it out; nulls, empty, long and damaged pages as there."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that go from every document, exact repeats of short lines included, as ``line_dedup.report`` decides."""
    return line_dedup.report(table(spark, sf_dir, "documents"), short=True)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by word shingles, as ``ngram_join.ngram_join`` links them; empty texts, ties and null ids as there."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that every document holds, as ``decontamination.report`` finds them; short items, nulls and long texts as there."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, as ``langid.identify`` learns and tells it."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, as ``toxicity.judge`` learns and scores it."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their places in sequences, as ``packing.pack`` plans them."""
    return packing.pack(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline`` over the documents, each written and read again."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digest of the base spans and all spans, as ``pii.scan`` finds them."""
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secret_sql() -> str:
    """Each rule's matches with the gaps between them, whose lengths add up to positions."""
    quoted = lambda x: "'" + x.replace("\\\"", '"').replace("'", "''") + "'"
    rules = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS b, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS p, regexp_split_to_array(t, {quoted(r.pattern)}) AS g FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        for i, r in enumerate(secrets.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({rules}), i AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM m),
x AS (SELECT doc_id, rank, kind, list_sum(list_transform(g[:i], lambda y: length(y))) + coalesce(list_sum(list_transform(b[:i - 1], lambda y: length(y))), 0) AS s, length(b[i]) AS n FROM i WHERE length(p[i]) >= least),
z AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM x)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id"""


_SQL = {
    "op1_secrets": _secret_sql(),
    "op2_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
    "op5_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_exact_dedup, op3_html_text, op4_line_dedup, op5_ngram_join, op6_decontamination, op7_langid, op8_toxicity, op9_packing, op10_pii, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
