"""Merging names of one thing: known synonyms first, then names that differ in case and punctuation only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import SYNONYMS
from graphloom.functions import text as T
from graphloom.graph import KnowledgeGraph
from graphloom.operators import upserts
from graphloom.plans.stage import not_broadcast, staged


def default_synonyms(spark: SparkSession) -> DataFrame:
    """``(alias, canonical)`` of the engine's own list."""
    return spark.createDataFrame(list(SYNONYMS.items()), "alias string, canonical string")


def synonym_map(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(label, name, canonical)`` of the entities that an alias ``(alias, canonical)`` renames.

    The alias is compared with the lower-cased name; names that differ from the canonical one in case only stay. Of
    several canonical names for one alias the first is taken.
    """
    known = synonyms.where("alias IS NOT NULL AND canonical IS NOT NULL").groupBy(F.lower(T.strip(F.col("alias"))).alias("__key")).agg(F.min("canonical").alias("canonical"))
    keyed = entities.select("label", "name", F.lower(T.strip(F.col("name"))).alias("__key"))
    return keyed.join(known, "__key").where(F.lower("canonical") != F.col("__key")).select("label", "name", "canonical")


def normal_map(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(label, name, canonical)`` of the entities whose normal form another one shares.

    Canonical is the one mentioned in most chunks; of equals the last name. ``mentions`` may hold a chunk repeatedly.
    """
    n = mentions.groupBy("label", "name").agg(F.count_distinct("chunk_id").alias("n"))
    keyed = entities.select("label", "name").distinct().join(not_broadcast(n), ["label", "name"], "left").select("label", "name", T.normal_name(F.col("name")).alias("__norm"), F.coalesce("n", F.lit(0)).alias("n"))
    best = keyed.groupBy("label", "__norm").agg(F.max_by("name", F.struct("n", "name")).alias("canonical"))
    return keyed.join(not_broadcast(best), ["label", "__norm"]).where("name <> canonical").select("label", "name", "canonical")


def rename(graph: KnowledgeGraph, mapping: DataFrame) -> KnowledgeGraph:
    """Merge each mapped entity into its canonical one.

    ``mapping (label, name, canonical[, through])``; ``through`` is a name in between, which becomes an alias as well.
    Aliases become the sorted union with the absorbed names; mention and evidence counts add up. Renaming may make
    loops; intervals must be computed anew.
    """
    through = F.col("through") if "through" in mapping.columns else F.lit(None).cast("string")
    m = mapping.select("label", "name", "canonical", through.alias("through"))
    named = graph.entities.join(m, ["label", "name"], "left").withColumn("to", F.coalesce("canonical", "name"))
    every = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "through"))
    one = named.select("label", "to", "umls_cui", F.explode(every).alias("alias"))
    other = F.when(F.col("alias") != F.col("to"), F.col("alias"))
    entities = one.groupBy("label", F.col("to").alias("name")).agg(F.array_sort(F.collect_set(other)).alias("aliases"), F.max("umls_cui").alias("umls_cui"))
    mentions = graph.mentions.join(m, ["label", "name"], "left").groupBy("label", F.coalesce("canonical", "name").alias("name"), "chunk_id").agg(F.sum("count").alias("count"))
    evidence = graph.evidence
    for end in ("src", "tgt"):
        side = m.select(F.col("label").alias(f"{end}_label"), F.col("name").alias(f"{end}_name"), F.col("canonical").alias("__c"))
        evidence = evidence.join(side, [f"{end}_label", f"{end}_name"], "left").withColumn(f"{end}_name", F.coalesce("__c", f"{end}_name")).drop("__c")
    evidence = upserts.summed_evidence(evidence)
    return graph.with_(entities=entities, mentions=mentions, edges=upserts.edges_of(evidence), evidence=evidence)


def name_map(graph: KnowledgeGraph, synonyms: DataFrame) -> DataFrame:
    """``(label, name, canonical, through)``: where both passes together take each name that they change.

    The second pass sees what the first one makes of entities and mentions, but only its names: mentions and evidence
    are keyed anew once, by both maps in one. Neither pass needs a closure, as each maps a name once.
    """
    first = not_broadcast(staged(synonym_map(graph.entities, synonyms), "synonyms"))
    to = first.withColumnRenamed("canonical", "__c")
    renamed = lambda df: df.join(to, ["label", "name"], "left").select("label", F.coalesce("__c", "name").alias("name"), *[c for c in df.columns if c not in ("label", "name")])
    second = not_broadcast(staged(normal_map(renamed(graph.entities.select("label", "name")), renamed(graph.mentions.select("label", "name", "chunk_id"))), "normal"))
    last = second.select("label", F.col("name").alias("__n"), F.col("canonical").alias("__l"))
    names = graph.entities.select("label", "name").distinct().join(to, ["label", "name"], "left").withColumn("__n", F.coalesce("__c", "name")).join(last, ["label", "__n"], "left")
    mapped = names.where("__c IS NOT NULL OR __l IS NOT NULL")
    return mapped.select("label", "name", F.coalesce("__l", "__n").alias("canonical"), F.col("__c").alias("through"))


def resolve(graph: KnowledgeGraph, synonyms: DataFrame) -> KnowledgeGraph:
    """Known synonyms, then normal forms; runs jobs, as the maps and what they make are written out."""
    graph = graph.staged("entities", "mentions", "evidence")
    mapping = not_broadcast(staged(name_map(graph, synonyms), "names"))
    made = rename(graph, mapping).staged("entities", "mentions", "evidence")
    return made.with_(edges=staged(upserts.edges_of(made.evidence), "edges"))
