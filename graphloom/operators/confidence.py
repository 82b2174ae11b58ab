"""Intervals of edges from their evidence and the co-mentions of their endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.graph import EDGE
from graphloom.plans.stage import not_broadcast, staged

#: Words of 64 bits of the filter of pairs (8 MB at most), and bits a pair while that suffices; more pairs pass more of the others.
MOST_WORDS, BITS_A_PAIR = 1 << 20, 16
PAIR = ("src_label", "src_name", "tgt_label", "tgt_name")


def _places(lo: Column, hi: Column, words: int) -> list[tuple[Column, Column]]:
    """``(word, bit)`` of a pair of hashes in the filter, twice; names are hashed already, so their bits only need mixing."""
    unsigned = F.shiftrightunsigned
    one = lo.bitwiseXOR(unsigned(hi, 5))
    two = unsigned(lo, 21).bitwiseXOR(unsigned(hi, 13))
    return [(h.bitwiseAND(words - 1).cast("int"), unsigned(h, 28).bitwiseAND(63).cast("int")) for h in (one, two)]


def _filter(pairs: DataFrame, words: int) -> Column:
    """The words of a Bloom filter of the pairs ``(lo, hi)`` as an array: a scalar of the query, made by its executors."""
    places = F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in _places(F.col("lo"), F.col("hi"), words)]))
    marks = pairs.select(places.alias("p")).groupBy(F.col("p.word").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))).alias("mask"))
    every = pairs.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask")).unionByName(marks)
    dense = every.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("words")).scalar()


def _hashed(edges: DataFrame) -> DataFrame:
    """The edges with the hashes ``lo`` and ``hi`` of their endpoints: equal for a loop, null where a part of one is null."""
    a, b = F.xxhash64("src_label", "src_name"), F.xxhash64("tgt_label", "tgt_name")
    known = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in PAIR))
    return edges.withColumns({"lo": F.when(known, F.least(a, b)), "hi": F.when(known, F.greatest(a, b))})


def _counts(hashed: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(lo, hi, n_chunks)`` for the pairs of :func:`_hashed` edges that a chunk mentions, and for some others."""
    pairs = staged(hashed.where("lo < hi").select("lo", "hi").distinct(), "pairs")
    n_pairs, words = pairs.count(), 1
    while words < MOST_WORDS and words * 64 < BITS_A_PAIR * n_pairs:
        words *= 2
    of_chunk = mentions.select(F.xxhash64("label", "name").alias("a"), "chunk_id").groupBy("chunk_id").agg(F.collect_set("a").alias("all"))  # of one chunk
    both = of_chunk.select(F.explode("all").alias("lo"), "all").select("lo", F.explode("all").alias("hi")).where("lo < hi")
    asked = _filter(pairs, words)
    for word, bit in _places(F.col("lo"), F.col("hi"), words):
        both = both.where(F.getbit(F.get(asked, word), bit) == 1)
    return not_broadcast(both.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n_chunks")))


def comention_counts(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks that mention both endpoints, for each distinct endpoint pair of the edges; none for a loop.

    Each chunk makes the pairs of its entities, of which those are shuffled, counted already, that pass a Bloom filter
    of the edges' pairs; a join then tells the few that aren't among them. So the driver holds a filter of some MB and
    no pairs, however many there are. Names are 64-bit hashes meanwhile.
    """
    hashed = _hashed(edges.select(*PAIR).distinct())
    return hashed.join(_counts(hashed, mentions), ["lo", "hi"]).select(*PAIR, "n_chunks")


def edge_intervals(edges: DataFrame, mentions: DataFrame, alpha: float = 0.05, boundary: str = "certain") -> DataFrame:
    """The edges with ``k``, ``n``, ``confidence_lower`` and ``confidence_upper``; edges without a count are left out.

    ``k`` is the evidence count, 1 for 0; ``n`` the chunks that mention both endpoints, at least ``k``.
    """
    counted = edges.where("evidence_count IS NOT NULL").drop("confidence_lower", "confidence_upper")
    hashed = _hashed(counted)
    joined = hashed.join(_counts(hashed, mentions), ["lo", "hi"], "left")
    k = F.when(F.col("evidence_count") == 0, F.lit(1)).otherwise(F.col("evidence_count")).cast("long")
    joined = joined.withColumn("k", k).withColumn("n", F.greatest(F.coalesce("n_chunks", F.lit(0)), "k"))
    ci = stats.wilson(F.col("k"), F.col("n"), alpha, boundary)
    return joined.withColumn("__ci", ci).select(*EDGE, "evidence_count", "k", "n", F.col("__ci.lower").alias("confidence_lower"), F.col("__ci.upper").alias("confidence_upper"))
