"""A stored vector index for the query path: a question reads the cells near its vector instead of all vectors.

Nodes are written by label and cell; a cell is that of the nearest of some centroids, which are fitted on a bounded
sample and stored beside them. A query compares its vector with the centroids and reads the ``probes`` nearest cells, by
partition pruning; with all cells the answer is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.operators.embed import nearest

#: Nodes a cell is meant to hold, the most cells, and vectors of the sample a cell.
CELL, MOST_CELLS, PER_CELL = 20_000, 4096, 20


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)


def _fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    centres = sample[np.random.default_rng(1).choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        for c in np.unique(home):
            centres[c] = sample[home == c].mean(axis=0)
        centres = _unit(centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """``nodes (key, embedding, label, cell)`` in a folder, and the centroids of its cells."""

    folder: str
    centres: np.ndarray

    @staticmethod
    def write(nodes: DataFrame, folder: str, vector: str = "embedding") -> VectorIndex:
        """Index the nodes ``(label, key, embedding)`` with a usable vector: neither null, nor all zero, nor holding NaN."""
        spark = nodes.sparkSession
        fit = F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
        usable = nodes.where(fit).select("label", "key", F.col(vector).cast("array<float>").alias("embedding"))
        sizes = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
        usable = usable.where(F.size("embedding") == dim)
        cells = max(1, min(MOST_CELLS, -(-n // CELL)))
        wanted = cells * PER_CELL + 1000
        share = F.pmod(F.xxhash64("label", "key"), F.lit(1 << 20)) <= int(min(1.0, 1.5 * wanted / max(1, n)) * (1 << 20))
        rows = usable.where(share).orderBy(F.xxhash64("key"), "key").limit(wanted).select("embedding").collect()
        sample = _unit(np.array([r[0] for r in rows], np.float32).reshape(-1, dim))
        centres = _fitted(sample, min(cells, len(sample))) if len(sample) else np.zeros((1, dim), np.float32)
        shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS at most
        schema = StructType([*usable.schema, StructField("cell", IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cell = (v @ shared.value.T).argmax(axis=1) if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=schema.names)

        usable.mapInArrow(run, schema).repartition("label", "cell").write.mode("overwrite").partitionBy("label", "cell").parquet(f"{folder}/nodes")
        table = [(i, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(table, "cell int, centre array<float>").write.mode("overwrite").parquet(f"{folder}/cells")
        return VectorIndex(folder, centres)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> VectorIndex:
        rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
        return VectorIndex(folder, np.array([r["centre"] for r in rows], np.float32))

    def search(self, spark: SparkSession, query: list[float], k: int, label: str | None = None, probes: int = 8) -> DataFrame:
        """``(key, embedding, label, cell, score)``: the ``k`` nearest nodes, of a label if given, in the ``probes`` nearest cells."""
        near = np.arange(len(self.centres))
        if self.centres.shape[1] == len(query):  # else no node has the query's length
            near = np.argsort(-(self.centres @ np.asarray(query, np.float32)), kind="stable")[:probes]
        nodes = spark.read.schema("key string, embedding array<float>, label string, cell int").parquet(f"{self.folder}/nodes")
        return nearest(nodes.where(F.col("cell").isin(near.tolist())), query, k, label=label)
