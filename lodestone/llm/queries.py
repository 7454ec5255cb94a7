"""The ten operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_extraction, jaccard_join, licenses, packing, pii, quality_rules, secrets, spans, spotsigs, toxicity
from .common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [spans.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(read_table(spark, sf_dir, "documents"), path_col="doc_id").withColumnRenamed("path", "doc_id")
    base = F.filter("findings", lambda x: x["kind"].isin(*secrets.BASE_KINDS))
    counts = [spans.count(F.col("findings"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("findings")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), token_pattern())


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT_FROM).cast("int").alias("predicted"), "evidence")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_spotsigs, op3_quality_rules, op4_secrets, op5_packing, op6_byte_bpe, op7_licenses, op8_jaccard_join, op9_toxicity, op10_html_extraction)}


# --- SQL for the same rows, where SQL can express a method's result

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secrets_sql() -> str:
    """Spans by what lies between matches and the matches themselves, rule by rule."""
    parts = []
    for rank, (kind, pattern, _, group, least) in enumerate(secrets.RULES[secrets.CURRENT]):
        p = pattern.replace("*+", "*").replace("++", "+").replace("}+", "}").replace("'", "''")
        counts = f"length(regexp_extract(hits[i], '{p}', {group}))" if group else "length(hits[i])"
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rk, pos AS a, pos + length(hits[i]) AS b FROM (SELECT doc_id, hits, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS pos
 FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS hits, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))) WHERE {counts} >= {least}""")
    one = "kind || ':' || a || ':' || b"
    base = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)
    return f"""WITH f AS ({" UNION ALL ".join(parts)}) SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY a, rk) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg({one}, ',' ORDER BY a, rk) FILTER (kind IS NOT NULL), '') AS spans
 FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op4_secrets": _secrets_sql(),
    "op8_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+', 0) AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS sh FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
 r(x, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
 SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
}
