"""Recognised spans: the recogniser seam, merging of two passes, labels and prompt hints."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import RECOGNISED_LABELS

#: A recogniser takes a text and gives ``(text, raw_label, start, end, cui, canonical, score)`` tuples.
Recognizer = Callable[[str], list[tuple]]
_made: dict[str, Callable | None] = {}


class PerWorker:
    """A model that every worker process makes for itself, once, by ``factory``; only the factory travels with the job.

    Stands for any callable seam (recogniser, extractor, embedder). Where the factory fails, as when a model or its
    library isn't there, ``missing`` is what calls give; None raises.
    """

    def __init__(self, factory: Callable[[], Callable], name: str, missing: Callable | None = None):
        self.factory, self.name, self.missing = factory, name, missing

    def __call__(self, *args):
        if self.name not in _made:
            try:
                _made[self.name] = self.factory()
            except Exception:  # noqa: BLE001 - any reason why a model can't be had
                if self.missing is None:
                    raise
                _made[self.name] = None
        model = _made[self.name]
        return self.missing(*args) if model is None else model(*args)
SPAN = "text string, raw_label string, start_char int, end_char int, umls_cui string, canonical_name string, score double"


class Gazetteer:
    """The offline recogniser: the longest names of a fixed list, at word bounds, in any case.

    Names are found by their first word, so a text costs about one lookup a word however long the list is.
    """

    WORD = re.compile(r"\w+")

    def __init__(self, names: list[tuple[str, str]]):
        self.by_first: dict[str, list[tuple[str, str, str]]] = {}
        for name, label in sorted(set(names)):
            first = self.WORD.search(name or "")
            if first and not first.start():
                self.by_first.setdefault(first.group().lower(), []).append((name.lower(), name, label))
        for found in self.by_first.values():
            found.sort(key=lambda x: (-len(x[0]), x))

    def __call__(self, text: str) -> list[tuple]:
        found, end, low = [], 0, (text or "").lower()
        if len(low) != len(text or ""):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in self.WORD.finditer(low):
            at = m.start()
            for key, name, label in self.by_first.get(m.group(), ()) if at >= end else ():
                stop = at + len(key)
                if low.startswith(key, at) and not (low[stop : stop + 1].isalnum() or low[stop : stop + 1] == "_"):
                    found.append((text[at:stop], label, at, stop, None, name, 1.0))
                    end = stop
                    break
        return found


def recognize(chunks: DataFrame, recognizer: Recognizer, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(key, pass fields of SPAN)``: the spans of each text, by a pluggable recogniser.

    A text on which the recogniser fails has no spans. A recogniser that is costly to make comes as :class:`PerWorker`.
    """

    def spans(value: str) -> list[tuple]:
        try:
            return recognizer(value)
        except Exception:  # noqa: BLE001 - a model that fails on a text says nothing of it
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, t in zip(pdf[key], pdf[text]) if isinstance(t, str) for s in spans(t)]
            yield pd.DataFrame(rows, columns=[key, "text", "raw_label", "start_char", "end_char", "umls_cui", "canonical_name", "score"])

    return chunks.select(key, text).mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, {SPAN}")


def merged_passes(first: DataFrame, second: DataFrame, key: str = "chunk_id") -> DataFrame:
    """All spans of the first pass, then those of the second whose exact place the first hasn't."""
    places = first.select(key, "start_char", "end_char").distinct()
    more = second.join(places, [key, "start_char", "end_char"], "left_anti")
    return first.withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))


def mapped_label(raw: Column, mapping: dict[str, str] = RECOGNISED_LABELS) -> Column:
    """Our label for a recogniser's; one that isn't mapped stands for itself."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, raw), raw)


def hint(text: Column, label: Column, canonical: Column, cui: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(
        F.lit("  - "), F.coalesce(text, F.lit("")), F.lit(" ("), F.coalesce(label, F.lit("")), F.lit(")"),
        F.when(some(canonical), F.concat(F.lit(" → "), canonical)).otherwise(F.lit("")),
        F.when(some(cui), F.concat(F.lit(" [UMLS:"), cui, F.lit("]"))).otherwise(F.lit("")),
    )


def prompt_hints(chunks: DataFrame, spans: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("start_char", "span_id")) -> DataFrame:
    """``(key, hints)`` of every chunk: a line per span in order, or a note that there are none."""
    line = hint(F.col("text"), F.col("label"), F.col("canonical_name"), F.col("umls_cui"))
    lines = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))  # spans of one chunk
    joined = chunks.select(key).distinct().join(lines, key, "left")
    return joined.select(key, F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("(none detected)")).alias("hints"))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
