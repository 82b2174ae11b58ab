"""Queries of problem 4: results per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import tree_aggregate as ta
from graphloom.sources.tables import table

SHARE = 0.04


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    names = ta.heavy_keys(table(spark, directory, "ner_entities").select("canonical_name"), "canonical_name", SHARE)
    papers = ta.heavy_keys(table(spark, directory, "chunks").select("paper_id"), "paper_id", SHARE)
    return names.unionByName(papers).select("key_field", "key_value")


def p4_names(spark: SparkSession, directory: str) -> DataFrame:
    spans = table(spark, directory, "ner_entities")
    return ta.tree_aggregate(
        spans,
        ["canonical_name"],
        [
            ta.count("n_spans"),
            ta.count("n_cuis", F.col("umls_cui")),
            ta.total("n_chars", F.length("text").cast("long")),
            ta.least("first_span", F.col("span_id")),
            ta.greatest("last_extracted", F.col("extracted_at")),
            ta.mean("mean_start", F.col("start_char").cast("long")),
        ],
    ).withColumn("last_extracted", F.unix_micros("last_extracted"))


def p4_papers(spark: SparkSession, directory: str) -> DataFrame:
    return ta.tree_aggregate(
        table(spark, directory, "chunks"),
        ["paper_id"],
        [
            ta.count("n_rows"),
            ta.count("n_texts", F.col("text")),
            ta.total("n_chars", F.length("text").cast("long")),
            ta.greatest("last_index", F.col("chunk_index")),
            ta.least("first_offset", F.col("char_offset")),
        ],
    )


def queries():
    return {"p4_found": p4_found, "p4_names": p4_names, "p4_papers": p4_papers}


def oracle_sql():
    return {
        "p4_found": """
            SELECT 'canonical_name' AS key_field, canonical_name AS key_value FROM ner_entities
            WHERE canonical_name IS NOT NULL GROUP BY canonical_name
            HAVING count(*) >= 0.04 * (SELECT count(*) FROM ner_entities)
            UNION ALL
            SELECT 'paper_id', paper_id FROM chunks WHERE paper_id IS NOT NULL GROUP BY paper_id
            HAVING count(*) >= 0.04 * (SELECT count(*) FROM chunks)""",
        "p4_names": """
            SELECT canonical_name, count(*) AS n_spans, count(umls_cui) AS n_cuis, CAST(sum(length(text)) AS BIGINT) AS n_chars,
                   min(span_id) AS first_span, epoch_us(max(extracted_at)) AS last_extracted,
                   CAST(sum(start_char) AS DOUBLE) / count(start_char) AS mean_start
            FROM ner_entities GROUP BY canonical_name""",
        "p4_papers": """
            SELECT paper_id, count(*) AS n_rows, count(text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars,
                   max(chunk_index) AS last_index, min(char_offset) AS first_offset
            FROM chunks GROUP BY paper_id""",
    }
