"""Reading documents: Markdown directories, other formats through converters; writing Markdown back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import newlines

#: A converter takes the bytes of a file and gives its text; one that raises, or gives too little, hands over to the next.
Converter = Callable[[bytes], str]
SHORTEST_TEXT = 200


def stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_markdown(spark: SparkSession, directory: str, paper_id: str | None = None) -> DataFrame:
    """``(paper_id, text)`` of the ``.md`` files of a directory, not of those below it; with one line end."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.md").select(stem(F.input_file_name()).alias("paper_id"), newlines(F.col("value")).alias("text"))
    return files if paper_id is None else files.where(F.col("paper_id") == paper_id)


def convert(spark: SparkSession, directory: str, converters: list[Converter], pattern: str = "*.pdf", done: DataFrame | None = None) -> DataFrame:
    """``(paper_id, text, error)`` of the binary files of a directory; those in ``done`` are skipped.

    The first converter that gives at least SHORTEST_TEXT characters wins; if none does, ``error`` says why.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory).select(stem(F.col("path")).alias("paper_id"), "content")
    if done is not None:
        files = files.join(done.select("paper_id").distinct(), "paper_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for paper, content in zip(pdf["paper_id"], pdf["content"]):
                text, why = None, "no converter"
                for converter in converters:
                    try:
                        text = converter(bytes(content))
                        if len(text.strip()) >= SHORTEST_TEXT:
                            why = None
                            break
                        text, why = None, "too little text"
                    except Exception as e:  # noqa: BLE001 - any failure hands over to the next
                        text, why = None, str(e)[:300]
                rows.append((paper, text, why))
            yield pd.DataFrame(rows, columns=["paper_id", "text", "error"])

    return files.mapInPandas(run, "paper_id string, text string, error string")


def write_markdown(documents: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """A folder per paper with one text file each; a distributed write that keeps the line ends."""
    documents.select("paper_id", F.col("text").alias("value")).write.mode(mode).partitionBy("paper_id").option("lineSep", "\n").text(directory)
