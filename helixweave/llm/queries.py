"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, license_scan, line_dedup, piece_lattice, quality, secrets, substring_dedup, token_counts, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("score", F.round("score", 6))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
    "pipeline": pipeline,
}

_DUP = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM words WHERE len(w) >= 20
), named AS (
  SELECT doc_id, s, sha256(array_to_string(w[s:s + 19], ' ')) AS k FROM windows
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM named) WHERE r > 1
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
"""


def _canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in license_scan.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def _license_sql() -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_scan.KNOWN)
    lines = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {_canonical('l')}), lambda c: c <> '' AND NOT regexp_matches(c, '{license_scan.COPYRIGHT}'))"
    return f"""
WITH known(license, text) AS (VALUES {known}),
ids AS (SELECT DISTINCT license, array_to_string({lines}, ' ') AS body FROM known),
docs AS (SELECT doc_id, {lines} AS lines FROM documents),
said AS (
  SELECT doc_id, unnest(lines) AS body, FALSE AS entire FROM docs
  UNION SELECT doc_id, array_to_string(lines, ' '), TRUE FROM docs
), found AS (
  SELECT doc_id, max(CASE WHEN entire THEN license END) AS whole_license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n
  FROM said JOIN ids USING (body) GROUP BY doc_id
)
SELECT documents.doc_id, whole_license, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses
FROM documents LEFT JOIN found ON documents.doc_id = found.doc_id
"""


ORACLES = {"op2_substring_dedup": _DUP, "op10_license_scan": _license_sql()}
