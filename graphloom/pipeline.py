"""From documents to a resolved, clean graph with intervals and vectors, as one chain of lazy plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import EngineConfig
from graphloom.graph import EDGE, KnowledgeGraph
from graphloom.operators import chunking, clean_graph, confidence, embed, extract, recognize, resolve, upserts
from graphloom.plans.stage import staged


@dataclass
class Pipeline:
    """``recognizer``, ``second``, ``extractors`` and ``embedder`` are the seams to models; the defaults work offline.

    ``second`` is a further recogniser whose spans are added where the first has none at their exact place.
    """

    recognizer: recognize.Recognizer
    extractors: list[extract.Extractor] = field(default_factory=lambda: [extract.pattern_extractor])
    embedder: embed.Embedder | None = None
    config: EngineConfig = EngineConfig()
    second: recognize.Recognizer | None = None

    def chunks(self, documents: DataFrame) -> DataFrame:
        c = self.config
        return chunking.chunks(documents, longest=c.longest_section, window=c.window, overlap=c.overlap)

    def recognized(self, chunks: DataFrame) -> DataFrame:
        """The labelled spans of both passes."""
        spans = recognize.recognize(chunks, self.recognizer)
        if self.second is not None:
            spans = recognize.merged_passes(spans, recognize.recognize(chunks, self.second))
        else:
            spans = spans.withColumn("pass", F.lit(1))
        return spans.withColumn("label", recognize.mapped_label(F.col("raw_label")))

    def extracted(self, chunks: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        """Raw answers of the chunks: cached ones where the text is the same, else from the extractors."""
        hits, misses = (None, chunks.withColumn("text_key", extract.cache_key(F.col("text")))) if cache is None else extract.cached(chunks, cache)
        hints = recognize.prompt_hints(misses, self.recognized(misses), order=("pass", "start_char", "end_char"))
        fresh = extract.extract(misses.join(hints, "chunk_id"), self.extractors)
        return fresh if hits is None else hits.unionByName(fresh, allowMissingColumns=True)

    def build(self, documents: DataFrame, papers: DataFrame, cache: DataFrame | None = None, done: DataFrame | None = None, save: str | None = None) -> KnowledgeGraph:
        """The graph of the documents; ``done (chunk_id)`` are chunks to skip.

        Answers are written to the folder ``save``, to be the ``cache`` of a later run, as soon as they are there.
        """
        spark = documents.sparkSession
        chunks = staged(self.chunks(documents), "chunks")
        todo = chunks if done is None else upserts.pending_chunks(chunks, done)
        raw = self.extracted(todo, cache).select("paper_id", "chunk_index", "chunk_id", "text_key", "raw")
        if save is None:
            raw = staged(raw, "answers")  # each text is extracted once
        else:
            raw.write.parquet(save)
            raw = spark.read.schema(raw.schema).parquet(save)
        answers = staged(extract.validated(raw, ["paper_id", "chunk_index", "chunk_id"]), "validated")
        entities, mentions, edges = upserts.build_events(answers)
        evidence = staged(upserts.upsert_evidence(edges), "evidence")
        graph = KnowledgeGraph(papers, chunks, upserts.upsert_entities(entities), upserts.upsert_mentions(mentions), upserts.edges_of(evidence), evidence)
        return self.with_intervals(graph.staged("entities", "mentions", "edges"))

    def with_intervals(self, graph: KnowledgeGraph) -> KnowledgeGraph:
        scored = confidence.edge_intervals(graph.edges, graph.mentions, self.config.alpha)
        return graph.with_(edges=scored.select(*EDGE, "evidence_count", "confidence_lower", "confidence_upper"))

    def refined(self, graph: KnowledgeGraph, synonyms: DataFrame | None = None) -> KnowledgeGraph:
        """Resolved, cleaned, and with the intervals of the merged evidence; by default with the engine's own synonyms."""
        synonyms = resolve.default_synonyms(graph.edges.sparkSession) if synonyms is None else synonyms
        return self.with_intervals(clean_graph.clean(resolve.resolve(graph, synonyms)).staged("entities", "mentions", "edges"))

    def embedded(self, graph: KnowledgeGraph) -> DataFrame:
        """``(label, key, text, embedding)`` of all nodes."""
        return embed.embed(embed.node_texts(graph, self.config), self.embedder, batch=self.config.embedding_batch)
