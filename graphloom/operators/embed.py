"""Texts that stand for nodes, their vectors, and exact nearest neighbours of a query vector."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import LABEL_PHRASES, PHRASES, EngineConfig
from graphloom.graph import KnowledgeGraph

Embedder = Callable[[list[str]], list[list[float]]]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def humanized(relation: Column) -> Column:
    """An edge type as it reads in a sentence."""
    return F.coalesce(_lookup(PHRASES, relation), F.regexp_replace(F.lower(relation), "_", " "))


def neighbourhood(edges: DataFrame, limit: int = 5) -> DataFrame:
    """``(label, name, context)``: the first edges out of and into each node, by evidence, as sentences."""

    def side(own: str, other: str, direction: int) -> DataFrame:
        rank = Window.partitionBy(f"{own}_label", f"{own}_name").orderBy(F.desc("evidence_count"), "rel_type", f"{other}_name", f"{other}_label")
        named = F.concat(F.col(f"{other}_name"), F.lit(" ("), F.col(f"{other}_label"), F.lit(")"))
        verb = humanized(F.col("rel_type"))
        part = F.concat(verb, F.lit(" "), named) if direction == 0 else F.concat(named, F.lit(" "), verb, F.lit(" this"))
        ranked = edges.withColumn("__i", F.row_number().over(rank)).where(F.col("__i") <= limit)
        return ranked.select(F.col(f"{own}_label").alias("label"), F.col(f"{own}_name").alias("name"), F.struct(F.lit(direction).alias("d"), F.col("__i"), part.alias("t")).alias("p"))

    parts = side("src", "tgt", 0).unionByName(side("tgt", "src", 1)).groupBy("label", "name").agg(F.array_sort(F.collect_list("p")).alias("p"))  # 2 x limit at most
    return parts.select("label", "name", F.concat(F.array_join(F.transform("p", lambda x: x["t"]), ". "), F.lit(".")).alias("context"))


def entity_texts(entities: DataFrame, edges: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(label, key, text)`` of the entities: label, name, aliases and neighbourhood."""
    joined = entities.join(neighbourhood(edges, config.neighbours), ["label", "name"], "left")
    some = F.size("aliases") > 0
    aliases = F.when(some, F.array_join(F.slice("aliases", 1, config.aliases_shown), ", ")).otherwise(F.lit("none"))
    head = F.coalesce(_lookup(LABEL_PHRASES, F.col("label")), F.col("label"))
    # fixed values: the sentences of an entity's text
    text = F.concat(head, F.lit(" "), "name", F.lit(". Also known as: "), aliases, F.lit(". "), F.coalesce("context", F.lit("No known relationships in graph.")))
    return joined.select("label", F.col("name").alias("key"), text.alias("text"))


def chunk_texts(chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``(label, key, text)`` of the chunks: section, paper and the beginning of the text."""
    e = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(e(F.col("section")), F.lit(" (from paper "), e(F.col("paper_id")), F.lit("): "), F.substring(e(F.col("text")), 1, config.chunk_chars))
    return chunks.select(F.lit("Chunk").alias("label"), F.col("chunk_id").alias("key"), text.alias("text"))


def node_texts(graph: KnowledgeGraph, config: EngineConfig = EngineConfig()) -> DataFrame:
    return entity_texts(graph.entities, graph.edges, config).unionByName(chunk_texts(graph.chunks, config))


class HashedWords:
    """The offline embedder: words hashed into signed counts, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out


def embed(texts: DataFrame, embedder: Embedder | None = None, text: str = "text", batch: int = 64) -> DataFrame:
    """The rows with ``embedding ARRAY<FLOAT>`` by a pluggable embedder, called in batches."""
    encode = embedder or HashedWords()

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            values = s.tolist()
            yield pd.Series([v for i in range(0, len(values), batch) for v in encode(values[i : i + batch])], dtype=object)

    return texts.withColumn("embedding", run(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null when one is null, has a length of zero, or they don't match."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, q: s + q * q))
    return F.when((F.size(a) == F.size(b)) & (length(x) > 0) & (length(y) > 0), dot / (length(x) * length(y)))


def nearest(nodes: DataFrame, query: list[float], k: int, key: str = "key", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """The ``k`` nodes, of a ``label`` if given, with the highest ``score`` = (1 + cosine) / 2; equal scores by key.

    NaN and misfits take no part. Exact, by one scan; :mod:`graphloom.operators.vector_index` reads a part only.
    """
    if label is not None:
        nodes = nodes.where(F.col("label") == label)
    q = F.lit([float(x) for x in query])
    score = (1 + cosine(F.col(vector), q)) / 2
    scored = nodes.withColumn("score", score).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)
