"""Upserts as keyed aggregation over event tables: idempotent, and combined before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import FALLBACK_LABEL, FALLBACK_RELATION, LABELS, RELATIONS
from graphloom.graph import EDGE, KnowledgeGraph


def label_or_fallback(label: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.when(label.isin(*labels), label).otherwise(F.lit(FALLBACK_LABEL))


def relation_or_fallback(relation: Column, relations: tuple[str, ...] = RELATIONS) -> Column:
    return F.when(relation.isin(*relations), relation).otherwise(F.lit(FALLBACK_RELATION))


def upsert_papers(events: DataFrame, order: str = "loaded_at") -> DataFrame:
    """Per paper: doi and year of its first row, and the latest title that isn't empty (else the first one)."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("title"))
    first = F.min_by(F.struct("title", "doi", "year"), F.struct(order, "title"))
    rows = events.where("paper_id IS NOT NULL").groupBy("paper_id").agg(first.alias("f"), F.max_by(titled, F.when(titled.isNotNull(), F.struct(order, "title"))).alias("t"))
    return rows.select("paper_id", F.coalesce("t", "f.title").alias("title"), "f.doi", "f.year")


def upsert_chunks(events: DataFrame, order: str = "loaded_at") -> DataFrame:
    """Per chunk the properties of its latest row."""
    others = [c for c in events.columns if c not in ("chunk_id", order)]
    rows = events.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("v"))
    return rows.select("chunk_id", "v.*")


def upsert_entities(events: DataFrame, strict: bool = False) -> DataFrame:
    """Per (label, name): aliases and identifier from events ``(seq, label, name, aliases, umls_cui)``.

    Aliases are the sorted union; ``strict`` takes those of the last event, be they none. The identifier is the
    latest one given.
    """
    rows = events.where("name IS NOT NULL").withColumn("label", label_or_fallback(F.col("label")))
    none = F.array().cast("array<string>")
    cui = F.max_by("umls_cui", F.when(F.col("umls_cui").isNotNull(), F.col("seq"))).alias("umls_cui")
    if strict:
        return rows.groupBy("label", "name").agg(F.max_by(F.coalesce("aliases", F.lit(none)), "seq").alias("aliases"), cui)
    one = rows.select("label", "name", "seq", "umls_cui", F.explode_outer("aliases").alias("alias"))
    grouped = one.groupBy("label", "name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), cui)
    return grouped


def upsert_mentions(events: DataFrame) -> DataFrame:
    """``count`` of each (label, name, chunk_id)."""
    return events.groupBy("label", "name", "chunk_id").agg(F.count(F.lit(1)).alias("count"))


def upsert_evidence(assertions: DataFrame) -> DataFrame:
    """``n`` assertions of each (edge, chunk), also repeated ones; an unknown type is the fallback."""
    rows = assertions.withColumn("rel_type", relation_or_fallback(F.col("rel_type")))
    return rows.groupBy(*EDGE, "chunk_id").agg(F.count(F.lit(1)).alias("n"))


def edges_of(evidence: DataFrame) -> DataFrame:
    """Per edge its assertions, counted from unique (edge, chunk) rows."""
    return evidence.groupBy(*EDGE).agg(F.sum("n").alias("evidence_count"))


def with_chunk_ids(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """The edges with ``source_chunk_ids``, the sorted ids of their chunks: for edges whose lists fit a row."""
    ids = evidence.groupBy(*EDGE).agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    return edges.join(ids, list(EDGE), "left")


def overwrite_confidence(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Count and interval of the edges in ``updates`` replaced; edges that don't exist aren't made."""
    fields = ("evidence_count", "confidence_lower", "confidence_upper")
    new = updates.select(*EDGE, F.struct(*fields).alias("__new"))
    joined = edges.join(new, list(EDGE), "left")
    kept = [F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c) if c in edges.columns else F.lit(None)).alias(c) for c in fields]
    return joined.select(*EDGE, *kept)


def set_embeddings(nodes: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes with the vector of their key, or the one they had."""
    new = vectors.select(*keys, F.col("embedding").alias("__e"))
    old = F.col("embedding") if "embedding" in nodes.columns else F.lit(None)
    return nodes.join(new, keys, "left").withColumn("embedding", F.coalesce("__e", old)).drop("__e")


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that aren't among ``done (chunk_id)``: the chunks that the graph of an earlier run has, with or without mentions."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def build_events(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity, mention and edge events of validated extractions ``(paper_id, chunk_index, chunk_id, entities, relationships)``.

    Events have the order in which a chunk-by-chunk build would write them: a chunk's entities, then both endpoints of
    each relation, without aliases and without a mention.
    """
    base = extracted.select("paper_id", "chunk_index", "chunk_id", "entities", "relationships")
    ent = base.select("paper_id", "chunk_index", "chunk_id", F.posexplode("entities").alias("i", "e"))
    rel = base.select("paper_id", "chunk_index", "chunk_id", F.posexplode("relationships").alias("i", "r"))

    def seq(phase: int, end: int) -> Column:
        return F.struct("paper_id", "chunk_index", F.lit(phase).alias("phase"), "i", F.lit(end).alias("end")).alias("seq")

    named = ent.select(seq(0, 0), F.col("e.type").alias("label"), F.col("e.name").alias("name"), F.col("e.aliases").alias("aliases"), F.lit(None).cast("string").alias("umls_cui"), "chunk_id")
    none = F.array().cast("array<string>").alias("aliases")
    ends = [rel.select(seq(1, k), F.col(f"r.{end}_type").alias("label"), F.col(f"r.{end}_name").alias("name"), none, F.lit(None).cast("string").alias("umls_cui")) for k, end in enumerate(("source", "target"))]
    edges = rel.select(
        F.col("r.source_type").alias("src_label"), F.col("r.source_name").alias("src_name"), F.col("r.relationship").alias("rel_type"), F.col("r.target_type").alias("tgt_label"), F.col("r.target_name").alias("tgt_name"), "chunk_id", F.col("i").alias("seq")
    )
    return named.drop("chunk_id").unionByName(ends[0]).unionByName(ends[1]), named.select("label", "name", "chunk_id"), edges


def summed_evidence(evidence: DataFrame) -> DataFrame:
    """Rows of one (edge, chunk) in one."""
    return evidence.groupBy(*EDGE, "chunk_id").agg(F.sum("n").alias("n"))


def merged(old: KnowledgeGraph, new: KnowledgeGraph) -> KnowledgeGraph:
    """Two graphs of different chunks in one: keys unite, counts add up and aliases become sorted unions.

    A paper of both keeps the new title unless it is empty, and the first doi and year that are known.
    """
    none = F.array().cast("array<string>")
    both = {t: getattr(old, t).unionByName(getattr(new, t), allowMissingColumns=True) for t in ("entities", "mentions", "evidence")}
    aliases = both["entities"].select("label", "name", "umls_cui", F.explode_outer(F.coalesce("aliases", none)).alias("alias"))
    evidence = summed_evidence(both["evidence"].select(*EDGE, "chunk_id", "n"))
    rows = old.papers.withColumn("loaded_at", F.lit(0)).unionByName(new.papers.withColumn("loaded_at", F.lit(1)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("loaded_at", c))).alias(c)
    titles = upsert_papers(rows).select("paper_id", "title")
    return KnowledgeGraph(
        titles.join(rows.groupBy("paper_id").agg(first("doi"), first("year")), "paper_id"),
        new.chunks.unionByName(old.chunks.join(new.chunks.select("chunk_id"), "chunk_id", "left_anti"), allowMissingColumns=True),
        aliases.groupBy("label", "name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.max("umls_cui").alias("umls_cui")),
        both["mentions"].groupBy("label", "name", "chunk_id").agg(F.sum("count").alias("count")),
        edges_of(evidence),
        evidence,
    )
