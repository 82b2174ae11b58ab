"""``python -m graphloom DOCUMENTS OUT``: documents to the tables of a graph, each run a new version of OUT.

The steps: other formats to Markdown (``--pdfs``), chunks, recognition and extraction, resolution, cleaning, intervals,
vectors. Answers of the extractors stay beside the versions, so a run over texts seen before extracts nothing.
"""

from __future__ import annotations

import argparse
from importlib import import_module
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import EngineConfig
from graphloom.functions import text as T
from graphloom.graph import TABLES, KnowledgeGraph
from graphloom.operators import extract
from graphloom.operators.recognize import Gazetteer
from graphloom.operators.upserts import merged
from graphloom.pipeline import Pipeline
from graphloom.plans.stage import only_kept
from graphloom.sources.markdown import Converter, convert, read_markdown, write_markdown

#: Names of the offline recogniser; more than this many would make its table too large for a task.
MOST_NAMES = 1_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _parts(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, out: str) -> list[str]:
    """The versions of a graph that were written whole, oldest first."""
    return [f for f in _parts(spark, out) if _exists(spark, f"{f}/edges/_SUCCESS")]


def load(spark: SparkSession, folder: str) -> KnowledgeGraph:
    return KnowledgeGraph(*(spark.read.parquet(f"{folder}/{t}") for t in TABLES))


def answers(spark: SparkSession, out: str) -> DataFrame | None:
    """The extractors' answers of all earlier runs; an answer is valid for a text with the same key."""
    found = [f for f in _parts(spark, f"{out.rstrip('/')}/_answers") if _exists(spark, f"{f}/_SUCCESS")]
    return spark.read.parquet(*found) if found else None


def converted(spark: SparkSession, pdfs: str, out: str, converters: list[Converter], paper: str | None = None) -> DataFrame:
    """``(paper_id, text)`` of the files of other formats, cleaned; those that an earlier run converted aren't again."""
    folder = f"{out.rstrip('/')}/_markdown"
    old = spark.read.schema("value string, paper_id string").text(folder, wholetext=True) if _exists(spark, folder) else None
    with only_kept(spark):
        new = convert(spark, pdfs, converters, done=old).where("text IS NOT NULL")
        if paper is not None:
            new = new.where(F.col("paper_id") == paper)
        write_markdown(new.select("paper_id", T.caps_headings(T.cleaned_markdown(T.newlines(F.col("text")), F.col("paper_id"))).alias("text")), folder, mode="append")
    files = spark.read.schema("value string, paper_id string").text(folder, wholetext=True).select("paper_id", F.col("value").alias("text"))
    return files if paper is None else files.where(F.col("paper_id") == paper)


def build(
    spark: SparkSession, documents: str, out: str, names: DataFrame, synonyms: DataFrame | None = None, paper: str | None = None, clear: bool = False, resume: bool = False,
    skip_embed: bool = False, pdfs: str | None = None, converters: list[Converter] | None = None, extractors: list[extract.Extractor] | None = None, config: EngineConfig | None = None,
) -> str:
    """Write the next version of the graph and give its folder.

    ``resume`` skips the chunks that the last version has, whatever was found in them, and adds the rest to it;
    ``clear`` starts anew; ``paper`` takes one document only. Names are always resolved and the graph cleaned, with
    ``synonyms`` or else the engine's own.
    """
    text = read_markdown(spark, documents, paper)
    if pdfs is not None:
        text = text.unionByName(converted(spark, pdfs, out, converters or [], paper).join(text.select("paper_id"), "paper_id", "left_anti"))
    listed = [(r["name"], r["label"]) for r in names.select("name", "label").limit(MOST_NAMES + 1).collect()]
    if len(listed) > MOST_NAMES:
        raise ValueError("too many names for the offline recogniser")
    pipeline = Pipeline(Gazetteer(listed), extractors or [extract.pattern_extractor], config=config or EngineConfig.from_env())
    before = versions(spark, out)
    old = load(spark, before[-1]) if before and resume and not clear else None
    papers = text.select("paper_id", T.title_of(F.col("text"), F.col("paper_id")).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"))
    begun = [int(f.rpartition("/v")[2]) for f in _parts(spark, out) if f.rpartition("/v")[2].isdigit()]  # whole or not
    number = max(begun, default=0) + 1
    folder = f"{out.rstrip('/')}/v{number:06d}"
    with only_kept(spark):
        graph = pipeline.build(text, papers, cache=answers(spark, out), done=old.chunks if old else None, save=f"{out.rstrip('/')}/_answers/v{number:06d}-{uuid4().hex}")
        if old:
            graph = merged(old, graph)
        graph = pipeline.refined(graph, synonyms)
        for t in TABLES:
            if t != "edges":
                getattr(graph, t).write.parquet(f"{folder}/{t}")
        if not skip_embed:
            pipeline.embedded(graph).write.parquet(f"{folder}/vectors")
        graph.edges.write.parquet(f"{folder}/edges")  # the last: a version without it isn't whole
    return folder


def _named(where: str) -> Converter:
    """A converter by ``module:function``."""
    module, _, name = where.partition(":")
    return getattr(import_module(module), name)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--names", required=True, help="Parquet table (label, name) for the offline recogniser")
    p.add_argument("--synonyms", help="Parquet table (alias, canonical) instead of the engine's own")
    p.add_argument("--pdfs", help="folder of files in other formats")
    p.add_argument("--converter", action="append", default=[], help="module:function that takes bytes and gives text; the first that does wins")
    p.add_argument("--paper")
    for flag in ("clear", "resume", "skip-pdf", "skip-embed"):
        p.add_argument(f"--{flag}", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    synonyms = spark.read.parquet(a.synonyms) if a.synonyms else None
    pdfs = None if a.skip_pdf else a.pdfs
    print(build(spark, a.documents, a.out, spark.read.parquet(a.names), synonyms, a.paper, a.clear, a.resume, a.skip_embed, pdfs, [_named(c) for c in a.converter]))


if __name__ == "__main__":
    main()
