"""The property graph as an immutable bundle of tables; every change gives a new bundle."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.stage import staged

#: Identity of an edge.
EDGE = ("src_label", "src_name", "rel_type", "tgt_label", "tgt_name")
TABLES = ("papers", "chunks", "entities", "mentions", "edges", "evidence")


@dataclass(frozen=True)
class KnowledgeGraph:
    """``papers (paper_id, title, doi, year)``, ``chunks (chunk_id, paper_id, section, chunk_index, text, ...)``,
    ``entities (label, name, aliases, umls_cui)``, ``mentions (label, name, chunk_id, count)``,
    ``edges (src_label, src_name, rel_type, tgt_label, tgt_name, evidence_count[, confidence_*])`` and
    ``evidence (src_label, ..., tgt_name, chunk_id, n)``: how often each chunk asserts an edge.

    The chunks of an edge stay rows, so that an edge which very many chunks assert is no oversized row; see
    :func:`graphloom.operators.upserts.with_chunk_ids` for the edges with arrays of them.
    """

    papers: DataFrame
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    evidence: DataFrame

    def with_(self, **tables: DataFrame) -> KnowledgeGraph:
        return replace(self, **tables)

    def cleared(self) -> KnowledgeGraph:
        """The graph without rows."""
        return KnowledgeGraph(*(getattr(self, t).limit(0) for t in TABLES))

    def staged(self, *tables: str) -> KnowledgeGraph:
        """The graph with its derived tables, or those named, written out, so that what follows doesn't compute them again."""
        return self.with_(**{t: staged(getattr(self, t), t) for t in tables or ("entities", "mentions", "edges", "evidence")})

    def run(self, query: str, **params) -> DataFrame:
        """A read-only SQL query over the tables by name, with ``:name`` parameters, which are values and never text."""
        spark = self.edges.sparkSession
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(t)
        return spark.sql(query, args=params)

    def all_edges(self) -> DataFrame:
        """Semantic and structural edges in one table, with nodes named ``label`` and ``key``."""
        semantic = self.edges.select("src_label", F.col("src_name").alias("src_key"), "rel_type", "tgt_label", F.col("tgt_name").alias("tgt_key"))
        mentioned = self.mentions.select(F.col("label").alias("src_label"), F.col("name").alias("src_key"), F.lit("MENTIONED_IN").alias("rel_type"), F.lit("Chunk").alias("tgt_label"), F.col("chunk_id").alias("tgt_key"))
        from_paper = self.chunks.join(self.papers.select("paper_id"), "paper_id", "left_semi").select(
            F.lit("Chunk").alias("src_label"), F.col("chunk_id").alias("src_key"), F.lit("FROM_PAPER").alias("rel_type"), F.lit("Paper").alias("tgt_label"), F.col("paper_id").alias("tgt_key")
        )
        return semantic.unionByName(mentioned).unionByName(from_paper)
