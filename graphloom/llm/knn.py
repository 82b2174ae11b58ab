"""Problem 2: the most similar vectors of every vector, with little loss.

Method: one hierarchical navigable small-world graph per shard, in flat neighbour arrays, and shard results merged.
Shards are the cells of a coarse clustering. A vector lies in the cell of its nearest centroid and in those whose
centroid is at most ``margin`` less similar, so that two similar vectors meet in a shard although they lie on two sides
of a border. The margin is no constant: the true neighbours of a few probes are found by comparing these with all
vectors, and the margin is the least with which the wanted share of them meets; so recall holds as cells multiply.
Every insertion into a shard's graph is a search for the new vector's neighbours, and what it finds counts for both
ends, so vectors aren't searched for again once the graph stands. Work grows with the vectors, not with their square.

Bounded on the driver: the sample that the centroids are fitted on (``SAMPLE`` vectors, or ``SAMPLE_PER_CELL`` a cell up
to ``MOST_SAMPLE``) and the probes. Every vector is indexed. From ``MOST_SAMPLE / SAMPLE_PER_CELL * CELL`` vectors on
(50 million) cells grow instead of multiplying; a graph's walks grow with the logarithm of its size only.

Equal vectors: of one that more than ``k + 1`` rows share only the ``k + 1`` first keys are indexed; they are each
other's answers, and those of all further keys of that vector, which are found by a join. A vector that a third of the
keys share costs no more than another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from graphloom.llm.hnsw import Graph

#: Vectors whose home a cell is meant to be, and the most cells that one vector lies in.
CELL, MOST_HOMES = 2000, 8
#: Vectors the centroids are fitted on: SAMPLE, or SAMPLE_PER_CELL a cell and MOST_SAMPLE at most.
SAMPLE, SAMPLE_PER_CELL, MOST_SAMPLE = 20_000, 8, 200_000
#: Vectors whose true neighbours tell the margin, and the share of these that shall meet in a shard.
PROBES, COVER = 256, 0.98
#: Vectors that more keys share than are indexed: up to this many of them are broadcast (8 MB), more are joined.
MOST_BROADCAST = 1_000_000
FOUND = StructType([StructField("key", StringType()), StructField("neighbour", StringType()), StructField("cosine", DoubleType())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of float32 vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _binary(vectors: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(vectors, np.float32)], pa.binary())


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(key STRING, vec BINARY)`` of the usable rows, scaled to length one; narrow."""
    schema = StructType([StructField("key", StringType()), StructField("vec", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                scaled = values / np.abs(values).max(axis=1, keepdims=True)
                scaled = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            usable = np.flatnonzero(np.isfinite(scaled).all(axis=1))  # neither NaN, null, infinite nor all zero
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), _binary(scaled[usable])], names=["key", "vec"])

    wanted = df.where(F.col(key).isNotNull() & (F.size(vector) == dim))
    return wanted.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, schema)


def centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of a spherical k-means; many are fitted in two levels, so the work grows with cells^1.5."""
    if cells > 512:
        coarse = int(cells**0.5)
        top = centroids(sample, coarse, rounds, seed)
        home = (sample @ top.T).argmax(axis=1)
        parts = [sample[home == c] for c in range(coarse)]
        share = [min(len(p), max(1, round(cells * len(p) / len(sample)))) for p in parts]
        return np.concatenate([centroids(p, n, rounds, seed) for p, n in zip(parts, share) if n])
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        filled, first = np.unique(home[order], return_index=True)
        centres[filled] = np.add.reduceat(sample[order], first, axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


class Plan:
    """Where vectors lie: the cells whose centroid is at most ``margin`` less similar than the nearest one."""

    def __init__(self, centres: np.ndarray, margin: float = 0.0, covered: float = 1.0):
        self.centres, self.margin, self.covered = centres, margin, covered

    def behind(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each vector, and by how much they are behind the nearest one."""
        scores = vectors @ self.centres.T
        most = min(MOST_HOMES, scores.shape[1])
        cells = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        near = np.take_along_axis(scores, cells, 1)
        return cells, near.max(axis=1, keepdims=True) - near

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells of all places in which the vectors lie."""
        cells, behind = self.behind(vectors)
        row, column = np.nonzero(behind <= self.margin)
        return row, cells[row, column]

    def calibrated(self, left: np.ndarray, right: np.ndarray, cover: float) -> Plan:
        """With the least margin with which a share ``cover`` of the pairs meets in some cell."""
        if not len(left):
            return self
        (a, x), (b, y) = self.behind(left), self.behind(right)
        need = np.where(a[:, :, None] == b[:, None, :], np.maximum(x[:, :, None], y[:, None, :]), np.inf).min(axis=(1, 2))
        margin = np.sort(need)[min(len(need) - 1, int(np.ceil(cover * len(need))) - 1)]
        reached = need[np.isfinite(need)]
        margin = float(margin if np.isfinite(margin) else reached.max(initial=0.0))
        return Plan(self.centres, margin, float((need <= margin).mean()))


def _true_neighbours(usable: DataFrame, probes: np.ndarray, keys: list[str], dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``k`` most similar vectors of each probe, found by comparing the probes with every vector; probes and neighbours."""
    shared = usable.sparkSession.sparkContext.broadcast((probes, np.array(keys, object)))  # PROBES vectors
    schema = StructType([StructField("probe", IntegerType()), StructField("key", StringType()), StructField("vec", BinaryType()), StructField("cosine", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shared.value
        best: list[list[tuple[float, str, bytes]]] = [[] for _ in own]
        floor = np.full(len(own), -2.0, np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = queries @ _matrix(batch.column(1), dim).T
            names, vectors = batch.column(0), batch.column(1)
            for q in np.flatnonzero(sims.max(axis=1) > floor):
                top = np.flatnonzero(sims[q] > floor[q])
                top = top[np.argsort(-sims[q, top], kind="stable")[: 2 * k + 2]]
                found = {(n, v): s for s, n, v in best[q]}
                found |= {(names[i].as_py(), vectors[i].as_py()): float(sims[q, i]) for i in top.tolist() if names[i].as_py() != own[q]}
                best[q] = sorted(((s, *nv) for nv, s in found.items()), reverse=True)[:k]
                floor[q] = best[q][-1][0] if len(best[q]) == k else -2.0
        rows = [(q, n, v, s) for q, found in enumerate(best) for s, n, v in found]
        kinds = (pa.int32(), pa.string(), pa.binary(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=schema.names)

    order = Window.partitionBy("probe").orderBy(F.desc("cosine"), "key")
    top = usable.select("key", "vec").mapInArrow(run, schema).withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k)
    rows = top.select("probe", "vec").distinct().collect()  # about PROBES x k
    pairs = np.array([r["probe"] for r in rows], np.int64)
    return probes[pairs], np.frombuffer(b"".join(r["vec"] for r in rows), np.float32).reshape(-1, dim)


def plan_cells(usable: DataFrame, n: int, dim: int, k: int, cover: float = COVER) -> Plan | None:
    """Centroids and margin for ``n`` vectors ``(key, vec)``; runs two jobs. None if there are no vectors."""
    wanted = min(MOST_SAMPLE, max(SAMPLE, SAMPLE_PER_CELL * -(-n // CELL)))
    share = min(1.0, 1.2 * wanted / n)
    picked = usable.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = picked.orderBy(F.xxhash64("key"), "key", "vec").select("key", "vec").limit(wanted).collect()
    if not rows:
        return None
    sample = np.frombuffer(b"".join(r["vec"] for r in rows), np.float32).reshape(-1, dim).copy()
    cells = max(1, min(-(-n // CELL), len(sample) // SAMPLE_PER_CELL))
    plan = Plan(centroids(sample, cells))
    if cells == 1:
        return plan
    return plan.calibrated(*_true_neighbours(usable, sample[:PROBES], [r["key"] for r in rows[:PROBES]], dim, k), cover)


def _routed(vectors: DataFrame, plan: Plan, dim: int) -> DataFrame:
    """``(shard, key, vec)``: each vector in all cells that it lies in, a partition per cell."""
    schema = StructType([StructField("shard", IntegerType()), StructField("key", StringType()), StructField("vec", BinaryType())])
    shared = vectors.sparkSession.sparkContext.broadcast(plan)  # MOST_SAMPLE / SAMPLE_PER_CELL centroids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = shared.value.homes(_matrix(batch.column(1), dim))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=schema.names)

    return vectors.select("key", "vec").mapInArrow(run, schema).repartition(len(plan.centres), "shard")


def _once(part: pa.Table, dim: int) -> tuple[np.ndarray, pa.Array]:
    """Vectors and keys of a shard in order, rows that came several times once."""
    part = part.select(["key", "vec"]).group_by(["key", "vec"]).aggregate([]).sort_by([("key", "ascending")]).combine_chunks()
    return _matrix(part["vec"].combine_chunks(), dim), part["key"].combine_chunks()


def _pairs(asked: pa.Array, keys: pa.Array, ids: np.ndarray, sims: np.ndarray, least: float) -> pa.Table:
    row, column = np.nonzero((ids >= 0) & (sims >= least))
    found = pa.table({"key": asked.take(pa.array(row)), "neighbour": keys.take(pa.array(ids[row, column])), "cosine": pa.array(sims[row, column].astype(np.float64))})
    return found.filter(pc.not_equal(found["key"], found["neighbour"]))


def build_index(vectors: DataFrame, plan: Plan, dim: int, m: int = 8, ef: int = 24) -> DataFrame:
    """``(shard, keys, graph)``: the graph of each shard in flat arrays, to be written and searched for other vectors."""

    def run(part: pa.Table) -> pa.Table:
        values, keys = _once(part, dim)
        graph = Graph.build(values, m, ef).to_bytes()
        return pa.table({"shard": part["shard"].slice(0, 1), "keys": pa.array([keys.to_pylist()], pa.list_(pa.string())), "graph": pa.array([graph], pa.binary())})

    return _routed(vectors, plan, dim).groupBy("shard").applyInArrow(run, "shard int, keys array<string>, graph binary")


def search_index(index: DataFrame, queries: DataFrame, plan: Plan, dim: int, k: int, ef: int = 24, least: float = -2.0) -> DataFrame:
    """``(key, neighbour, cosine)``: the ``k`` nearest indexed keys of each query ``(key, vec)``, merged over shards."""

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows or not shard.num_rows:
            return pa.table({"key": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        graph, keys = Graph.from_bytes(shard["graph"][0].as_py()), shard["keys"].combine_chunks().flatten()
        ids, sims = graph.search(_matrix(asked["vec"].combine_chunks(), dim), k + 1, ef)
        return _pairs(asked["key"].combine_chunks(), keys, ids, sims, least)

    found = _routed(queries, plan, dim).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(run, FOUND)
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Shard results merged: each neighbour of a key once, and the ``k`` best of a key; one shuffle."""
    once = found.repartition("key").groupBy("key", "neighbour").agg(F.max("cosine").alias("cosine"))
    nearest = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return once.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n")


def neighbours(df: DataFrame, key: str = "key", vector: str = "embedding", dim: int = 64, k: int = 5, least: float = -2.0, cover: float = COVER, m: int = 8, ef: int = 40) -> DataFrame:
    """``(key, neighbour, cosine)``: for each usable vector the ``k`` other keys with the highest cosine of at least ``least``.

    Vectors that are null, not ``dim`` long, all zero, or hold a null, NaN or infinity take no part, nor do null keys;
    a row that repeats counts once; of equal cosines the first keys count; other columns don't matter; an empty table
    gives no rows. ``least`` is applied before results are merged, as it can't change which of the rest are nearest.
    Counting and the choice of cells run as jobs while the query is put together.
    """
    raw = df.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("v"))
    raw = raw.withColumn("vh", F.xxhash64("v"))
    shared = raw.groupBy("vh").agg(F.count(F.lit(1)).alias("n"))
    size = shared.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > k + 1, 1)).alias("hot")).first()
    heads, rest = raw, None
    if size["hot"]:
        hot = shared.where(F.col("n") > k + 1).select("vh")
        hot = F.broadcast(hot) if size["hot"] <= MOST_BROADCAST else hot
        by_vector = Window.partitionBy("vh").orderBy("key")
        first = raw.join(hot, "vh").select("key", "v", "vh").withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= k + 1).dropDuplicates(["vh", "key"]).drop("n")
        heads = raw.join(hot, "vh", "left_anti").select("key", "v", "vh").unionByName(first)
        full = first.groupBy("vh").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("key")).alias("first"), F.first("v").alias("v")).where(F.col("n") == k + 1)  # k + 1 keys
        fit = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
        full = full.where(fit).select("vh", "last", "first")
        rest = raw.select("key", "vh").join(F.broadcast(full) if size["hot"] <= MOST_BROADCAST // 100 else full, "vh").where(F.col("key") > F.col("last"))
        rest = rest.select("key", F.explode(F.slice("first", 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine")).distinct()
    usable = unit_vectors(heads, "key", "v", dim)
    plan = plan_cells(usable, size["n"], dim, k, cover) if size["n"] else None
    if plan is None:
        return df.sparkSession.createDataFrame([], FOUND)

    def run(part: pa.Table) -> pa.Table:
        values, keys = _once(part, dim)
        graph = Graph.build(values, m, ef, keep=k + 1)
        return _pairs(keys, keys, *graph.near, least)

    best = _best(_routed(usable, plan, dim).groupBy("shard").applyInArrow(run, FOUND), k)
    return best if rest is None else best.unionByName(rest)


def similar_pairs(nearest: DataFrame) -> DataFrame:
    """``(key_a, key_b)``, ``key_a < key_b``, of the pairs where one is among the nearest of the other."""
    return nearest.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
