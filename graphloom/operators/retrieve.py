"""Retrieval over a graph: lookups, keyword, vector and hybrid search, rankings and views for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import LABELS
from graphloom.functions.stats import interval_text
from graphloom.graph import KnowledgeGraph
from graphloom.operators.embed import nearest
from graphloom.operators.paths import best_of

CHUNK = ("chunk_id", "paper_id", "section", "text")


def contains(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def relationships(graph: KnowledgeGraph, label: str, name: str, strict: bool = False) -> DataFrame:
    """Edges of an entity with their direction; ``strict`` gives the outgoing ones, once by target and once by itself."""
    e = graph.edges
    lower, upper = (F.col(c) if c in e.columns else F.lit(None).cast("double") for c in ("confidence_lower", "confidence_upper"))
    e = e.withColumn("confidence_lower", lower).withColumn("confidence_upper", upper)
    rest = ["evidence_count", "confidence_lower", "confidence_upper"]
    own = e.where((F.col("src_label") == label) & (F.col("src_name") == name))
    out = own.select(F.lit("out").alias("direction"), "rel_type", F.col("tgt_label").alias("other_label"), F.col("tgt_name").alias("other_name"), *rest)
    if strict:
        back = own.select(F.lit("out").alias("direction"), "rel_type", F.col("src_label").alias("other_label"), F.col("src_name").alias("other_name"), *rest)
    else:
        to = e.where((F.col("tgt_label") == label) & (F.col("tgt_name") == name))
        back = to.select(F.lit("in").alias("direction"), "rel_type", F.col("src_label").alias("other_label"), F.col("src_name").alias("other_name"), *rest)
    return out.unionByName(back).distinct()


def keyword_chunks(chunks: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """The first chunks by id whose text has the keyword, in any case."""
    return chunks.where(contains(F.col("text"), keyword)).select(*CHUNK).orderBy("chunk_id").limit(limit)


def search_entity(entities: DataFrame, name: str, label: str = "Any", limit: int = 10, aliases: bool = True) -> DataFrame:
    """Entities whose name, or an alias, has the text in any case: at most ``limit`` of each label, by name."""
    if label != "Any":
        entities = entities.where(F.col("label") == label)
    hit = contains(F.col("name"), name)
    if aliases:
        hit = hit | F.coalesce(F.exists("aliases", lambda a: contains(a, name)), F.lit(False))
    return best_of(entities.where(hit), ["label"], ["name"], limit).select("label", "name", "aliases")


def edge_lookup(graph: KnowledgeGraph, src: tuple[str, str], relation: str, tgt: tuple[str, str]) -> DataFrame:
    """One row with interval and count of an edge, or nulls and 0."""
    spark = graph.edges.sparkSession
    e = graph.edges.where((F.col("src_label") == src[0]) & (F.col("src_name") == src[1]) & (F.col("rel_type") == relation.upper()) & (F.col("tgt_label") == tgt[0]) & (F.col("tgt_name") == tgt[1]))
    one = e.select(F.lit(1).alias("one"), "confidence_lower", "confidence_upper", "evidence_count").limit(1)
    return spark.range(1).select(F.lit(1).alias("one")).join(one, "one", "left").select(F.col("confidence_lower").alias("lower"), F.col("confidence_upper").alias("upper"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def chunk_lookup(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """One row with the text of a chunk, or a note that there is none."""
    one = chunks.where(F.col("chunk_id") == chunk_id).select("chunk_id", "text", F.lit(True).alias("there"))
    asked = chunks.sparkSession.createDataFrame([(chunk_id,)], "chunk_id string")
    return asked.join(one, "chunk_id", "left").select(F.when(F.col("there"), F.col("text")).otherwise(F.lit("Chunk not found")).alias("text"))


def node_counts(graph: KnowledgeGraph, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(label, n)`` of papers, chunks and every label, with zeros."""
    every = graph.papers.select(F.lit("Paper").alias("label")).unionByName(graph.chunks.select(F.lit("Chunk").alias("label"))).unionByName(graph.entities.select("label"))
    names = graph.papers.sparkSession.createDataFrame([(x,) for x in ("Paper", "Chunk", *labels)], "label string")
    return names.join(every.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def edge_counts(graph: KnowledgeGraph) -> DataFrame:
    """``(rel_type, n)``, structural types too, the commonest first."""
    return graph.all_edges().groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type")


def totals(graph: KnowledgeGraph) -> DataFrame:
    """One row: papers, chunks and entities."""
    n = node_counts(graph)
    own = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return n.agg(own(F.col("label") == "Paper").alias("papers"), own(F.col("label") == "Chunk").alias("chunks"), own(~F.col("label").isin("Paper", "Chunk")).alias("entities"))


def rank_papers(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` papers with the best chunk, of those with one among the best ``3 k`` chunks."""
    best = nearest(chunks, query, 3 * k, "chunk_id")
    return best.groupBy("paper_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "paper_id").limit(k)


def hybrid_search(graph: KnowledgeGraph, vectors: DataFrame, query: list[float], keyword: str, k: int = 5, expand: bool = False) -> DataFrame:
    """``(pos, chunk_id, paper_id, section, text, score)``: nearest chunks, then chunks with the keyword, first seen kept.

    With ``expand``, the chunks of the entities of the first 3 follow (3 entities by name a chunk, 3 chunks a name).
    At most ``2 k`` rows.
    """
    chunks = graph.chunks
    near = nearest(vectors, query, k).select(F.col("key").alias("chunk_id"), "score")
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # k rows
    words = keyword_chunks(chunks, keyword, k).select("chunk_id", F.lit(None).cast("double").alias("score"))
    words = words.withColumn("rank", F.lit(k) + F.row_number().over(Window.orderBy("chunk_id")))
    base = best_of(near.unionByName(words), ["chunk_id"], ["rank"], 1)
    base = base.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    if expand:
        first = base.where("rank <= 3").select(F.col("rank").alias("r1"), "chunk_id")
        named = best_of(first.join(graph.mentions, "chunk_id"), ["r1"], ["label", "name"], 3).select("r1", "label", "name")
        named = named.withColumn("r2", F.row_number().over(Window.partitionBy("r1").orderBy("label", "name")))
        names = named.select("name").distinct()
        by_name = best_of(graph.mentions.join(F.broadcast(names), "name").select("name", "chunk_id").distinct(), ["name"], ["chunk_id"], 3)  # at most 9 names
        more = named.join(by_name, "name").select("chunk_id", F.struct("r1", "r2", "chunk_id").alias("o")).groupBy("chunk_id").agg(F.min("o").alias("o"))
        more = more.join(base.select("chunk_id"), "chunk_id", "left_anti").withColumn("rank", F.lit(2 * k) + F.row_number().over(Window.orderBy("o")))
        base = base.unionByName(more.select("chunk_id", F.lit(None).cast("double").alias("score"), "rank"))
    ordered = base.withColumn("pos", F.row_number().over(Window.orderBy("rank"))).where(F.col("pos") <= 2 * k)
    return chunks.select(*CHUNK).join(F.broadcast(ordered), "chunk_id").select("pos", *CHUNK, "score")  # 2 k rows at most


def texts_in_order(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``(pos, chunk_id, text)`` for ``ids (pos, chunk_id)``; ids without a chunk are skipped."""
    return ids.join(chunks.select("chunk_id", "text"), "chunk_id").select("pos", "chunk_id", "text").orderBy("pos")


def evidence_ids(trace: DataFrame) -> DataFrame:
    """``(pos, chunk_id)``: ids of chunks in a trace ``(seq, pos, id)``, each at its first place."""
    ids = trace.where(F.col("id").contains("__")).groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("seq", "pos")).alias("o"))
    return ids.select(F.row_number().over(Window.orderBy("o", "chunk_id")).alias("pos"), "chunk_id")


def relationship_table(graph: KnowledgeGraph, label: str, name: str) -> DataFrame:
    """The relationships of an entity with the interval as text, a dash where there is none."""
    shown = interval_text(F.col("confidence_lower"), F.col("confidence_upper"))
    interval = F.when(F.col("confidence_lower").isNotNull() & F.col("confidence_upper").isNotNull(), shown).otherwise(F.lit("—"))
    return relationships(graph, label, name).select("direction", "rel_type", "other_label", "other_name", "evidence_count", interval.alias("interval"))


def chunk_browser(chunks: DataFrame, paper_id: str) -> DataFrame:
    return chunks.where(F.col("paper_id") == paper_id).select("chunk_id", "section", "chunk_index", "text").orderBy("chunk_index", "chunk_id")


def chunk_entities(graph: KnowledgeGraph, chunk_id: str) -> DataFrame:
    return graph.mentions.where(F.col("chunk_id") == chunk_id).select("label", "name", "count").orderBy("label", "name")


def subgraph(graph: KnowledgeGraph, evidence: list[str], chunks: int = 3, entities: int = 8, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(name, label)`` and edges of a picture of the first evidence chunks: one edge per pair of names."""
    spark = graph.edges.sparkSession
    ids = spark.createDataFrame(list(enumerate(evidence[:chunks])), "pos int, chunk_id string")
    rows = best_of(graph.mentions.join(F.broadcast(ids), "chunk_id"), ["pos"], ["label", "name"], entities)
    first = rows.withColumn("i", F.row_number().over(Window.orderBy("pos", "label", "name"))).where(F.col("i") <= most)
    nodes = first.groupBy("name").agg(F.min_by("label", "i").alias("label"))
    names = F.broadcast(nodes.select("name"))  # at most ``most`` rows
    inside = graph.edges.join(names.withColumnRenamed("name", "src_name"), "src_name").join(names.withColumnRenamed("name", "tgt_name"), "tgt_name").where("src_name <> tgt_name")
    pair = [F.least("src_name", "tgt_name").alias("a"), F.greatest("src_name", "tgt_name").alias("b")]
    edges = inside.groupBy(*pair).agg(F.min(F.struct("src_name", "rel_type", "tgt_name")).alias("e")).select("e.src_name", "e.rel_type", "e.tgt_name")
    return nodes, edges


def evidence_passages(chunks: DataFrame, ids: list[str], most: int = 6, chars: int = 500) -> DataFrame:
    """The beginnings of the first evidence chunks."""
    asked = chunks.sparkSession.createDataFrame(list(enumerate(ids[:most], 1)), "pos int, chunk_id string")
    return texts_in_order(chunks, F.broadcast(asked)).select("pos", "chunk_id", F.substring("text", 1, chars).alias("passage"))
