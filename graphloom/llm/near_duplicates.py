"""Problem 3: records that share most of their content but differ by small edits, found and grouped.

Method: odd sketches. Each text becomes a set of word runs, of which MinHash takes ``bands * rows`` samples. Samples
are folded into a parity bitmap: every (sample number, value) pair flips one bit, so the XOR of two bitmaps holds only
the differing samples, and its population count tells the share of equal samples precisely where similarity is high.
Bands of samples propose candidates, the bitmaps (8 longs, compared in generated code) verify them, and the pairs that
pass are compared exactly by their sets of runs.

At scale: texts are read where they lie and only fixed-size sketches move. Texts with the same words make one class
that is compared once, so copies cost nothing. A band shared by more than ``crowd`` classes is expanded in blocks: its
members are salted into blocks, every pair of blocks is a group of its own, and the sketches are compared there, so only
pairs that pass are shuffled, each in the first band that it shares. The work in such a band is quadratic in its classes.
No text is shuffled: the exact check fetches the texts of candidates by a broadcast set of their ids while that is small
(its size is counted first), else by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from graphloom.llm import shingles
from graphloom.plans.stage import drop_staged, only_kept, staged

WORDS_OF_SKETCH = 8
BITS_OF_SKETCH = 64 * WORDS_OF_SKETCH
#: Ids up to this number are broadcast (8 MB of longs); more are joined.
MOST_BROADCAST = 1_000_000
#: Classes of a block of a crowded band, and how many of them are compared with another block at once.
BLOCK, TILE = 4096, 64


def _sketches(texts: list[str], run: int, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """For the texts with at least one run: their places, word-sequence hashes, band keys and odd sketches."""
    word, bounds = shingles.words(texts)
    hashes, edges = shingles.runs(word, bounds, run)
    kept = np.flatnonzero(np.diff(edges) > 0)
    if not len(kept):
        return kept, np.zeros(0, np.int64), np.zeros((0, bands), np.int64), np.zeros((0, WORDS_OF_SKETCH), np.int64)
    starts = edges[:-1][kept]
    # the same words in the same order: the sum of the runs, each mixed with its place
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(edges)[kept])
    same = np.add.reduceat(shingles.mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    samples = bands * rows
    seeds = shingles.mix(np.arange(1, samples + 1, dtype=np.uint64))
    low = np.empty((samples, len(kept)), np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    buffer = np.empty_like(short)
    other = np.empty_like(short)
    for i, seed in enumerate(seeds):
        np.bitwise_xor(short, np.uint32(seed & np.uint64(0xFFFFFFFF)), out=buffer)
        np.multiply(buffer, np.uint32((seed >> np.uint64(32)) | np.uint64(1)), out=buffer)
        np.right_shift(buffer, np.uint32(15), out=other)
        np.bitwise_xor(buffer, other, out=buffer)
        np.multiply(buffer, np.uint32(0x846CA68B), out=buffer)
        np.minimum.reduceat(buffer, starts, out=low[i])
    tagged = shingles.mix(low.astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32))[:, None])
    keys = shingles.mix(tagged.reshape(bands, rows, -1).sum(axis=1, dtype=np.uint64)).view(np.int64).T
    bit = (tagged % np.uint64(BITS_OF_SKETCH)).astype(np.int64) + np.arange(len(kept)) * BITS_OF_SKETCH
    odd = (np.bincount(bit.ravel(), minlength=len(kept) * BITS_OF_SKETCH) & 1).astype(np.uint8)
    return kept, same.view(np.int64), keys, np.packbits(odd.reshape(len(kept), -1), axis=1).view(np.int64)


def sketch(df: DataFrame, key: str, text: str, run: int = 3, bands: int = 32, rows: int = 5) -> DataFrame:
    """``(key, same, bands, sketch)`` of the rows whose text has at least ``run`` words; narrow."""
    schema = StructType([df.schema[key], StructField("same", LongType()), StructField("bands", ArrayType(LongType())), StructField("sketch", ArrayType(LongType()))])

    def per_row(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(lengths // 400_000)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                kept, same, keys, bits = _sketches(part.column(1).to_pylist(), run, bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(same), per_row(keys), per_row(bits)], names=schema.names)

    wanted = df.where(F.col(key).isNotNull() & (F.length(text) > 2 * run - 2)).select(F.col(key), F.col(text).alias("__text"))
    return wanted.mapInArrow(run_, schema)


def estimated(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples, from two odd sketches of ``samples`` MinHash values each."""
    differing = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, WORDS_OF_SKETCH)), F.bit_count(a[0].bitwiseXOR(b[0])))
    share = F.least(F.lit(1.0) - F.lit(2.0) * differing / BITS_OF_SKETCH, F.lit(1.0))
    flipped = F.when(share > 0, F.log(share) * (-BITS_OF_SKETCH / 2)).otherwise(F.lit(float("inf")))
    return F.lit(1.0) - flipped / (2.0 * samples)


def _pairs_of_lists(lists: DataFrame, ids: str) -> DataFrame:
    """All pairs ``a < b`` of the elements of sorted, bounded arrays."""
    indexed = lists.select(F.posexplode(ids).alias("__i", "a"), F.col(ids))
    return indexed.select("a", F.explode(F.slice(F.col(ids), F.col("__i") + 2, F.greatest(F.size(ids) - F.col("__i") - 1, F.lit(0)))).alias("b"))


def _most_differing(least: float, samples: int) -> int:
    """The most differing bits of two odd sketches whose :func:`estimated` similarity is at least ``least``."""
    shares = ((d, 1 - 2 * d / BITS_OF_SKETCH) for d in range(BITS_OF_SKETCH // 2))
    return max((d for d, share in shares if 1 + math.log(share) * BITS_OF_SKETCH / 4 / samples >= least), default=-1)


def _pairs_of_blocks(members: DataFrame, most: int | None) -> DataFrame:
    """Pairs ``a < b`` of ``(band, lo, hi, block, same, bands[, sketch])`` across the blocks ``lo`` and ``hi`` of a band.

    With ``most`` only pairs whose sketches differ in at most that many bits; a pair comes in the first band it shares.
    """

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        band, lo, hi = (group[c][0].as_py() for c in ("band", "lo", "hi"))
        same, block = group["same"].to_numpy(), group["block"].to_numpy()
        wide = {c: group[c].combine_chunks().flatten().to_numpy().reshape(len(same), -1) for c in ("bands", "sketch") if c in group.column_names}
        earlier = wide["bands"][:, : int((wide["bands"][0] == band).argmax())].T
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        for at in range(0, len(left), TILE):
            x, y = left[at : at + TILE], right[at:] if lo == hi else right
            hit = np.ones((len(x), len(y)), bool)
            if lo == hi:
                hit = x[:, None] < y
            if most is not None:
                differing = np.zeros(hit.shape, np.uint16)
                for bits in wide["sketch"].T:
                    differing += np.bitwise_count((bits[x][:, None] ^ bits[y]).view(np.uint64))
                hit &= differing <= most
            for key in earlier if hit.any() else ():
                hit &= key[x][:, None] != key[y]
            i, j = np.nonzero(hit)
            a, b = same[x[i]], same[y[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return members.groupBy("band", "lo", "hi").applyInArrow(run_, "a long, b long")


def shared_bands(classes: DataFrame) -> DataFrame:
    """``(same, band, n)`` of the bands that ``n`` > 1 classes share.

    Counted as a partial aggregate, so no task meets all members of a hot band; the members join the counts afterwards,
    without a shuffle while the shared bands are few enough to be broadcast.
    """
    by_band = classes.select("same", F.explode("bands").alias("band"))
    counts = staged(by_band.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    few = counts.count() <= MOST_BROADCAST
    return staged(by_band.join(F.broadcast(counts) if few else counts, "band").select("same", "band", "n"), "bands")


def candidates(classes: DataFrame, crowd: int = 48, block: int = BLOCK, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` of classes that share a band: those of small bands, distinct, and those of crowded ones.

    With ``most`` the classes have a ``sketch``, and pairs from crowded bands differ in at most that many bits.
    """
    counted = shared_bands(classes)
    lists = counted.where(F.col("n") <= crowd).groupBy("band").agg(F.array_sort(F.collect_set("same")).alias("ids"))  # at most crowd
    few = _pairs_of_lists(lists, "ids").distinct()
    crowded = counted.where(F.col("n") > crowd)
    ids = crowded.select("same").distinct()
    held = classes.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "same", "left_semi")
    blocks = F.ceil(F.col("n") / block)
    salted = crowded.withColumn("block", F.pmod(F.xxhash64("band", "same"), blocks)).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = salted.select("band", F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi"), "block", "same")
    wide = ["bands"] if most is None else ["bands", "sketch"]
    return few, _pairs_of_blocks(placed.join(held.select("same", *wide), "same"), most)


def _run_sets(df: DataFrame, run: int) -> DataFrame:
    """``(same, runs ARRAY<BIGINT>)``: the distinct runs of each text."""
    schema = StructType([StructField("same", LongType()), StructField("runs", ArrayType(LongType()))])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, edges = shingles.runs(*shingles.words(part.column(1).to_pylist()), run)
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    return df.mapInArrow(run_, schema)


def near_duplicates(df: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = 0.7, run: int = 3, bands: int = 32, rows: int = 5, slack: float = 0.18) -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, same)`` and links ``(a, b, similarity)`` between classes of texts with the same words.

    Similarity is the Jaccard coefficient of the sets of runs of ``run`` words; links have at least ``threshold``.
    A key that comes several times counts once (all its rows have one text); null keys, null, empty and blank texts
    and texts of fewer than ``run`` words have no runs and take no part; other columns don't matter; empty tables give
    empty results. With the defaults a pair at the threshold is proposed with probability 0.997 and a higher one more
    surely; ``slack`` is 4.2 standard deviations (0.042) of the estimate there, which loses 0.0001, and what passes is
    exact.
    """
    with only_kept(df.sparkSession) as kept:
        sketches = staged(sketch(df, key, text, run, bands, rows), "sketches")
        members = sketches.groupBy(F.col(key)).agg(F.min("same").alias("same"))
        heads = sketches.groupBy("same").agg(F.min(key).alias("__head"), F.min_by("bands", key).alias("bands"), F.min_by("sketch", key).alias("sketch"))
        classes = staged(heads, "classes")
        few, many = candidates(classes.select("same", "bands", "sketch"), most=_most_differing(threshold - slack, bands * rows))
        bits = classes.select("same", "sketch")
        near = (
            few.join(bits.select(F.col("same").alias("a"), F.col("sketch").alias("__x")), "a")
            .join(bits.select(F.col("same").alias("b"), F.col("sketch").alias("__y")), "b")
            .where(estimated(F.col("__x"), F.col("__y"), bands * rows) >= threshold - slack)
            .select("a", "b")
        )
        near = staged(near.unionByName(many).distinct(), "near")
        ids = near.select(F.explode(F.array("a", "b")).alias("same")).distinct()
        wanted = staged(classes.select("same", F.col("__head").alias(key)).join(ids, "same"), "wanted")
        few_ids = wanted.count() <= MOST_BROADCAST
        texts = df.select(key, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
        texts = texts.join(F.broadcast(wanted) if few_ids else wanted, key).select("same", "__text")
        sets = staged(_run_sets(texts, run).dropDuplicates(["same"]), "runs")
        common = F.size(F.array_intersect("__x", "__y"))
        links = (
            near.join(sets.select(F.col("same").alias("a"), F.col("runs").alias("__x")), "a")
            .join(sets.select(F.col("same").alias("b"), F.col("runs").alias("__y")), "b")
            .select("a", "b", (common / (F.size("__x") + F.size("__y") - common)).alias("similarity"))
            .where(F.col("similarity") >= threshold)
        )
        kept += [staged(members, "members"), staged(links, "links")]
    return kept[0], kept[1]


def pairs(members: DataFrame, links: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key_a, key_b)`` with ``key_a < key_b``: all pairs of different keys, within classes and across links."""
    left = members.select(F.col(key).alias("x"), F.col("same").alias("a"))
    right = members.select(F.col(key).alias("y"), F.col("same").alias("b"))
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within.unionByName(across).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every id in the links ``(a, b)``: the least id of its connected component.

    Large and small stars in turn until nothing changes: every round links neighbours to the least one they know, so
    the longest path shrinks geometrically; each round is written out, and no group is ever collected.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = staged(small, "edges")
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        drop_staged(edges)
        edges = after
        if same:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, group_id, n_links)``: one row per key with its group and the number of classes linked to its own."""
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("same")).groupBy("same").agg(F.count(F.lit(1)).alias("n_links"))
    joined = members.join(roots.withColumnRenamed("id", "same"), "same", "left").join(degree, "same", "left")
    return joined.select(key, F.coalesce("root", "same").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
