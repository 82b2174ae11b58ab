"""Extraction of entities and relations: prompts, the extractor seam with fallbacks, tolerant parsing, validation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import FALLBACK_LABEL, LABELS, RELATIONS
from graphloom.functions.text import let, strip

#: An extractor takes ``(text, hints)`` and gives raw JSON; one that raises hands over to the next.
Extractor = Callable[[str, str], str]

SYSTEM = (
    "Read the passage and list what it says as JSON with two arrays. 'entities' holds objects with name, type and "
    f"aliases; type is one of {', '.join(LABELS)}. 'relationships' holds objects with source_name, source_type, "
    f"relationship, target_name, target_type and evidence; relationship is one of {', '.join(RELATIONS)}. "
    "Write JSON only and state nothing that the passage doesn't."
)


def prompt(hints: Column, text: Column) -> Column:
    """The message to an extractor: hints of the recogniser, then the passage."""
    return F.concat(F.lit("Recognised spans:\n"), hints, F.lit("\n\nPassage:\n"), text)


def cache_key(text: Column) -> Column:
    """The first 12 hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def cached(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with a valid cached answer ``raw``, and those to extract; an answer to another text isn't valid."""
    keyed = chunks.withColumn("text_key", cache_key(F.col("text")))
    names = ["paper_id", "chunk_index", "text_key"]
    hits = keyed.join(cache.select(*names, "raw").dropDuplicates(names), names)
    return hits, keyed.join(cache.select(*names), names, "left_anti")


def pattern_extractor(text: str, hints: str) -> str:
    """The offline extractor: the hinted spans as entities, each span associated with the next one of its sentence."""
    spans = [line[4:].partition(" (") for line in hints.split("\n") if line.startswith("  - ")]
    named = [(name, rest.partition(")")[0]) for name, _, rest in spans if name]
    relations = []
    for (a, la), (b, lb) in zip(named, named[1:]):
        i = text.find(a)
        j = text.find(b, i + len(a)) if i >= 0 else -1
        if j >= 0 and "." not in text[i + len(a) : j] and a != b:
            relations.append({"source_name": a, "source_type": la, "relationship": "ASSOCIATED_WITH", "target_name": b, "target_type": lb, "evidence": text[i : j + len(b)]})
    return json.dumps({"entities": [{"name": n, "type": t, "aliases": []} for n, t in dict.fromkeys(named)], "relationships": relations})


def extract(chunks: DataFrame, extractors: list[Extractor] | None = None) -> DataFrame:
    """The chunks ``(…, text, hints)`` with ``raw``: the first answer of the extractors that don't raise, else ``{}``."""
    order = extractors or [pattern_extractor]

    def first(text: str, hints: str) -> str:
        for extractor in order:
            try:
                return extractor(text or "", hints or "")
            except Exception:  # noqa: BLE001, S112 - any failure of a provider hands over to the next
                continue
        return "{}"

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hints in batches:
            yield pd.Series([first(t, h) for t, h in zip(texts, hints)], dtype=object)

    return chunks.withColumn("raw", run("text", "hints"))


def parsed(raw: Column) -> Column:
    """The JSON of an answer as a VARIANT: the whole of it, else from the first brace to the last; null if neither parses."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))))


def _list(variant: Column, field: str) -> Column:
    """The objects in a list of an answer, as ``ARRAY<STRUCT<i, v>>`` with their places in it."""
    every = F.try_variant_get(variant, f"$.{field}", "array<variant>")
    placed = F.transform(every, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.filter(placed, lambda x: F.schema_of_variant(x["v"]).startswith("OBJECT"))


def _string(item: Column, field: str) -> Column:
    """A field of an item if it is a string, else null."""
    value = F.try_variant_get(item, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{field}", "string"))


def entity_list(variant: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """``ARRAY<STRUCT<i, name, type, aliases>>`` of a parsed answer: see :func:`valid_entities`."""

    def made(x: Column) -> Column:
        v = x["v"]
        label = F.when(F.try_variant_get(v, "$.type", "variant").isNull(), F.lit(FALLBACK_LABEL)).otherwise(_string(v, "type"))
        aliases = F.coalesce(F.try_variant_get(v, "$.aliases", "array<variant>"), F.array().cast("array<variant>"))
        strings = F.transform(F.filter(aliases, lambda a: F.schema_of_variant(a) == "STRING"), lambda a: F.try_variant_get(a, "$", "string"))
        return F.struct(x["i"].alias("i"), strip(_string(v, "name")).alias("name"), label.alias("type"), strings.alias("aliases"))

    return F.filter(F.transform(_list(variant, "entities"), made), lambda e: F.coalesce((e["name"] != "") & e["type"].isin(*labels), F.lit(False)))


def relationship_list(variant: Column, labels: tuple[str, ...] = LABELS, relations: tuple[str, ...] = RELATIONS, evidence: int = 300) -> Column:
    """``ARRAY<STRUCT<i, source_name, ...>>`` of a parsed answer: see :func:`valid_relationships`."""
    known = lambda c: F.when(c.isin(*labels), c).otherwise(F.lit(FALLBACK_LABEL))

    def made(x: Column) -> Column:
        v = x["v"]
        return F.struct(
            x["i"].alias("i"),
            strip(_string(v, "source_name")).alias("source_name"),
            known(_string(v, "source_type")).alias("source_type"),
            F.upper(_string(v, "relationship")).alias("relationship"),
            strip(_string(v, "target_name")).alias("target_name"),
            known(_string(v, "target_type")).alias("target_type"),
            F.substring(F.coalesce(F.try_variant_get(v, "$.evidence", "string"), F.lit("")), 1, evidence).alias("evidence"),
        )

    named = lambda r: F.coalesce((r["source_name"] != "") & (r["target_name"] != "") & r["relationship"].isin(*relations), F.lit(False))
    return F.filter(F.transform(_list(variant, "relationships"), made), named)


def _exploded(df: DataFrame, list_: Column) -> DataFrame:
    keys = [c for c in df.columns if c != "raw"]
    return df.select(*keys, F.explode(list_).alias("__e")).select(*keys, "__e.*")


def valid_entities(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(…, i, name, type, aliases)`` of the answers ``raw``: objects with a name; a missing type is the fallback, another one drops the item; aliases that aren't strings are dropped."""
    return _exploded(df, let(parsed(F.col("raw")), lambda v: entity_list(v, labels)))


def valid_relationships(df: DataFrame, labels: tuple[str, ...] = LABELS, relations: tuple[str, ...] = RELATIONS, evidence: int = 300) -> DataFrame:
    """``(…, i, source_name, source_type, relationship, target_name, target_type, evidence)``: objects with both names and a known relation in any case; an unknown endpoint type is the fallback; evidence is cut."""
    return _exploded(df, let(parsed(F.col("raw")), lambda v: relationship_list(v, labels, relations, evidence)))


def validated(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per chunk with its ``entities`` and ``relationships`` as arrays in order; each answer is parsed once, within its row."""
    both = let(parsed(F.col("raw")), lambda v: F.struct(entity_list(v).alias("entities"), relationship_list(v).alias("relationships")))
    return df.select(*keys, both.alias("__b")).select(*keys, "__b.*")
