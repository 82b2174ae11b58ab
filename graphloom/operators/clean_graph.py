"""Removing noise from a graph: isolated entities, names that say nothing, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import STOPWORDS
from graphloom.functions import text as T
from graphloom.graph import KnowledgeGraph


def is_trivial(name: Column) -> Column:
    """At most one character, or digits and dots only."""
    return (F.length(name) <= 1) | name.rlike(r"\A[0-9.]+\z")


def is_stopwords(name: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Nothing but stopwords, and at least one."""
    w = T.words(F.lower(name))
    return (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*stopwords))


def endpoints(graph: KnowledgeGraph) -> DataFrame:
    """``(label, name)`` of every entity that an edge touches."""
    ends = [graph.edges.select(F.col(f"{e}_label").alias("label"), F.col(f"{e}_name").alias("name")) for e in ("src", "tgt")]
    return ends[0].unionByName(ends[1]).unionByName(graph.mentions.select("label", "name")).distinct()


def without_isolated(graph: KnowledgeGraph) -> KnowledgeGraph:
    return graph.with_(entities=graph.entities.join(endpoints(graph), ["label", "name"], "left_semi"))


def _edges(graph: KnowledgeGraph, kept: Column) -> dict[str, DataFrame]:
    return {"edges": graph.edges.where(kept), "evidence": graph.evidence.where(kept)}


def without(graph: KnowledgeGraph, unwanted) -> KnowledgeGraph:
    """Without the entities whose name is unwanted, and what touches them."""
    keep = lambda c: ~F.coalesce(unwanted(F.col(c)), F.lit(False))
    return graph.with_(entities=graph.entities.where(keep("name")), mentions=graph.mentions.where(keep("name")), **_edges(graph, keep("src_name") & keep("tgt_name")))


def without_loops(graph: KnowledgeGraph) -> KnowledgeGraph:
    return graph.with_(**_edges(graph, F.expr("NOT (src_label = tgt_label AND src_name = tgt_name)")))


def clean(graph: KnowledgeGraph) -> KnowledgeGraph:
    """The four passes in order; what the later ones isolate stays until the next run."""
    return without_loops(without(without(without_isolated(graph), is_trivial), is_stopwords))


def clean_stats(graph: KnowledgeGraph) -> DataFrame:
    """One row with what each pass removes from the graph that the one before left; entities and edges are read once."""
    name = F.col("name")
    touched = graph.entities.join(endpoints(graph).withColumn("__touched", F.lit(True)), ["label", "name"], "left")
    kind = F.when(F.col("__touched").isNull(), "isolated_nodes").when(is_trivial(name), "trivial_name_nodes").when(is_stopwords(name), "stopword_nodes")
    empty = F.coalesce(is_trivial(F.col("src_name")), F.lit(False)) | F.coalesce(is_stopwords(F.col("src_name")), F.lit(False))
    loops = graph.edges.where("src_label = tgt_label AND src_name = tgt_name").where(~empty)
    every = touched.select(kind.alias("what")).unionByName(loops.select(F.lit("self_loops").alias("what")))
    return every.agg(*[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in ("isolated_nodes", "trivial_name_nodes", "stopword_nodes", "self_loops")])
