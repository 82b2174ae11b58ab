"""The graph that the queries run on: papers, chunks and spans of the test tables, with spans as mentions.

A span whose canonical name is listed under its label mentions that entity; neighbouring spans of a chunk assert an
edge, whose type follows from their labels. Types outside the vocabulary show the fallback at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.config import RELATIONS
from graphloom.graph import KnowledgeGraph
from graphloom.operators import upserts
from graphloom.plans.stage import staged
from graphloom.sources.tables import first_delivery, table

SPAN_COLUMNS = ["chunk_id", "text", "label", "raw_label", "start_char", "end_char", "umls_cui", "canonical_name"]
RELATION = """CASE WHEN src_label = 'Drug' AND tgt_label IN ('Gene', 'Protein') THEN 'TARGETS' WHEN src_label = 'Drug' THEN 'INHIBITS'
  WHEN src_label = 'Gene' AND tgt_label = 'Disease' THEN 'MUTATED_IN' WHEN src_label IN ('Gene', 'Protein') AND tgt_label = 'CellType' THEN 'EXPRESSED_IN'
  WHEN src_label = 'Protein' THEN 'BINDS' WHEN tgt_label = 'Pathway' THEN 'INVOLVES' ELSE 'RELATED_TO' END"""


def spans(spark: SparkSession, directory: str) -> DataFrame:
    """Each span once."""
    return first_delivery(table(spark, directory, "ner_entities"), "span_id", SPAN_COLUMNS)


def linked(spark: SparkSession, directory: str) -> DataFrame:
    """The spans with a listed canonical name; only the columns that the graph needs are read."""
    names = table(spark, directory, "entities").select("label", F.col("name").alias("canonical_name")).distinct()
    once = first_delivery(table(spark, directory, "ner_entities"), "span_id", ["chunk_id", "label", "start_char", "canonical_name"])
    return once.join(names, ["label", "canonical_name"], "left_semi")


def assertions(named: DataFrame, name: str) -> DataFrame:
    """An edge from each span to the next one of its chunk."""
    order = Window.partitionBy("chunk_id").orderBy("start_char", "span_id")
    pairs = named.select(
        "chunk_id",
        F.col("span_id").alias("seq"),
        F.col("label").alias("src_label"),
        F.col(name).alias("src_name"),
        F.lead("label").over(order).alias("tgt_label"),
        F.lead(name).over(order).alias("tgt_name"),
    )
    return pairs.where("tgt_label IS NOT NULL").withColumn("rel_type", F.expr(RELATION))


def papers(spark: SparkSession, directory: str) -> DataFrame:
    return upserts.upsert_papers(table(spark, directory, "papers"))


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    once = first_delivery(table(spark, directory, "chunks"), "chunk_id", ["paper_id", "section", "chunk_index", "text"])
    return once.withColumn("paper_id", F.coalesce("paper_id", F.regexp_replace("chunk_id", "__[^_]*$", "")))


def graph(spark: SparkSession, directory: str, known: DataFrame | None = None) -> KnowledgeGraph:
    known = linked(spark, directory) if known is None else known
    mentions = upserts.upsert_mentions(known.select("label", F.col("canonical_name").alias("name"), "chunk_id"))
    evidence = upserts.upsert_evidence(assertions(known, "canonical_name"))
    entities = table(spark, directory, "entities").select("label", "name", "aliases", "umls_cui")
    return KnowledgeGraph(papers(spark, directory), chunks(spark, directory), entities, mentions, upserts.edges_of(evidence), evidence)


def staged_graph(spark: SparkSession, directory: str) -> KnowledgeGraph:
    """The graph with its spans written out once and everything derived from them: for queries that read several tables."""
    g = graph(spark, directory, staged(linked(spark, directory), "spans")).staged("mentions", "evidence")
    return g.with_(edges=upserts.edges_of(g.evidence))


def written(spark: SparkSession, directory: str, stage: bool = False) -> KnowledgeGraph:
    """The graph of the spans as they are written, before any resolution; ``stage`` writes its spans and mentions out first."""
    once = first_delivery(table(spark, directory, "ner_entities"), "span_id", ["chunk_id", "text", "label", "start_char"])
    named = once.where("label IS NOT NULL AND text IS NOT NULL")
    if stage:
        named = staged(named, "spans")
    mentions = upserts.upsert_mentions(named.select("label", F.col("text").alias("name"), "chunk_id"))
    if stage:
        mentions = staged(mentions, "mentions")
    entities = mentions.select("label", "name").distinct().select("label", "name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("umls_cui"))
    evidence = upserts.upsert_evidence(assertions(named, "text"))
    return KnowledgeGraph(papers(spark, directory), chunks(spark, directory), entities, mentions, upserts.edges_of(evidence), evidence)


def noisy(spark: SparkSession, directory: str, stage: bool = False) -> KnowledgeGraph:
    """The graph with the words of the papers' titles as further entities; short words are mentioned by first chunks."""
    g = staged_graph(spark, directory) if stage else graph(spark, directory)
    titles = g.papers.select("paper_id", F.explode(F.split("title", r"\s+")).alias("name")).where("name <> ''")
    words = titles.select(F.lit("Mechanism").alias("label"), "name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("umls_cui")).distinct()
    short = titles.where(F.length("name") <= 6).select(F.lit("Mechanism").alias("label"), "name", F.format_string("%s__%04d", "paper_id", F.lit(0)).alias("chunk_id"))
    fresh = words.join(g.entities.select("label", "name"), ["label", "name"], "left_anti")
    return g.with_(entities=g.entities.unionByName(fresh), mentions=g.mentions.unionByName(upserts.upsert_mentions(short)))


def hubs(g: KnowledgeGraph, n: int) -> list[tuple[str, str]]:
    """The entities that most chunks mention."""
    top = g.mentions.groupBy("label", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label", "name").limit(n)
    return [(r["label"], r["name"]) for r in top.collect()]


# -- the same in SQL ------------------------------------------------------------------------------------------------

KNOWN = ", ".join(f"'{r}'" for r in RELATIONS)
S = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY loaded_at NULLS LAST) AS rn FROM ner_entities WHERE span_id IS NOT NULL) WHERE rn = 1)"
LK = f"{S}, lk AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM entities e WHERE e.label = s.label AND e.name = s.canonical_name))"


def sql_edges(source: str, name: str, pre: str = "") -> str:
    return f"""{pre}men AS (SELECT label, {name} AS name, chunk_id, count(*) AS count FROM {source} GROUP BY 1, 2, 3)
, asr AS (SELECT * FROM (SELECT chunk_id, span_id AS seq, label AS src_label, {name} AS src_name, lead(label) OVER w AS tgt_label, lead({name}) OVER w AS tgt_name
          FROM {source} WINDOW w AS (PARTITION BY chunk_id ORDER BY start_char, span_id)) WHERE tgt_label IS NOT NULL)
, typ AS (SELECT *, CASE WHEN r IN ({KNOWN}) THEN r ELSE 'ASSOCIATED_WITH' END AS rel_type FROM (SELECT *, {RELATION} AS r FROM asr))
, ebc AS (SELECT src_label, src_name, rel_type, tgt_label, tgt_name, chunk_id, count(*) AS n FROM typ GROUP BY ALL)
, edg AS (SELECT src_label, src_name, rel_type, tgt_label, tgt_name, CAST(sum(n) AS BIGINT) AS evidence_count, list(chunk_id ORDER BY chunk_id) AS source_chunk_ids FROM ebc GROUP BY 1, 2, 3, 4, 5)"""


G = f"{LK}, {sql_edges('lk', 'canonical_name')}"
WRITTEN = f"{S}, wr AS (SELECT * FROM s WHERE label IS NOT NULL AND text IS NOT NULL), {sql_edges('wr', 'text')}, went AS (SELECT DISTINCT label, name FROM men)"
PAPERS = """pap AS (SELECT paper_id, coalesce(arg_max(title, loaded_at) FILTER (WHERE coalesce(title, '') <> ''), arg_min(title, loaded_at)) AS title,
  min_by({'d': doi, 'y': year}, loaded_at) AS f FROM papers WHERE paper_id IS NOT NULL GROUP BY 1)"""
CHUNKS = """chu AS (SELECT chunk_id, coalesce(paper_id, regexp_replace(chunk_id, '__[^_]*$', '')) AS paper_id, section, chunk_index, text FROM
  (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"""
HUB = "hub AS (SELECT label, name, row_number() OVER (ORDER BY count(*) DESC, label, name) AS i FROM men GROUP BY label, name)"
NOISY = rf"""{G}, {PAPERS}, {CHUNKS}
, tw AS (SELECT paper_id, name FROM (SELECT paper_id, unnest(string_split_regex(title, '\s+')) AS name FROM pap) WHERE name <> '')
, nent AS (SELECT label, name FROM entities UNION SELECT 'Mechanism', name FROM tw)
, nmen AS (SELECT * FROM men UNION ALL SELECT 'Mechanism', name, paper_id || '__0000', count(*) FROM tw WHERE length(name) <= 6 GROUP BY 1, 2, 3)
, ends AS (SELECT src_label AS label, src_name AS name FROM edg UNION SELECT tgt_label, tgt_name FROM edg UNION SELECT label, name FROM nmen)"""
