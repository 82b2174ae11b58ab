"""Markdown to sections to chunks, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T


#: Places between which running sums are kept; within a stretch they are added up anew.
STRETCH = 256


def _running(values: Column, i: Column) -> Column:
    """The sum of the elements before place ``i``, of an array of structs ``(v, upto)`` made by :func:`_with_sums`."""
    block = F.floor(i / STRETCH).cast("int")
    own = F.slice(values["v"], block * STRETCH + 1, i % STRETCH)
    return F.element_at(values["before"], block + 1) + F.aggregate(own, F.lit(0), lambda s, x: s + x)


def _with_sums(values: Column) -> Column:
    """An array of integers with the sums before every STRETCH-th place, so that a long one costs no square of its length."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(values) / STRETCH).cast("int"))
    total = lambda b: F.aggregate(F.slice(values, b * STRETCH + 1, F.lit(STRETCH)), F.lit(0), lambda s, x: s + x)
    sums = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return F.struct(values.alias("v"), sums.alias("before"))


def _section_list(text: Column) -> Column:
    """``ARRAY<STRUCT<pos, section, body, char_offset>>`` of a document, all of it computed within the row."""
    t = T.newlines(text)

    def listed(parts: Column) -> Column:
        bodies, heads = parts["b"], parts["h"]
        only = F.size(heads) == 0
        sizes = F.transform(bodies, lambda b, i: F.length(b) + F.when(i == 0, F.lit(0)).otherwise(F.length(F.element_at(heads, F.greatest(i, F.lit(1))))))

        def one(sums: Column) -> Column:
            def made(b: Column, i: Column) -> Column:
                head = F.element_at(heads, F.greatest(i, F.lit(1)))
                name = F.when(only, F.lit("Introduction")).when(i == 0, F.lit("Preamble")).otherwise(T.clean_header(head))
                body = F.when(only, b).otherwise(T.strip(b))
                return F.struct(i.alias("pos"), name.alias("section"), body.alias("body"), _running(sums, i).cast("int").alias("char_offset"))

            return F.filter(F.transform(bodies, made), lambda p: only | (p["body"] != ""))

        return T.let(_with_sums(sizes), one)

    return T.let(t, lambda x: T.let(F.struct(F.split(x, T.HEADER).alias("b"), F.regexp_extract_all(x, F.lit(T.HEADER), F.lit(1)).alias("h")), listed))


def sections(df: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """``(key, pos, section, body, char_offset)``: the sections of each document with something in them; narrow.

    A document without headers is one section ``Introduction``, even if it is empty; what stands before the first
    header is ``Preamble``. Offsets are those of the headers in code points. Null texts give no sections.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.explode(_section_list(F.col(text))).alias("__s"))
    return rows.select(key, "__s.*")


def window_starts(n: Column, window: int, overlap: int) -> Column:
    """Starts of the windows over ``n`` words: none begins when the one before has reached the end."""
    step = window - overlap
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < n))


def windows(df: DataFrame, body: str = "body", section: str = "section", longest: int = 1200, window: int = 600, overlap: int = 150) -> DataFrame:
    """Each row once, or, where ``body`` has more than ``longest`` words, once per window of it, with its ``part``."""
    rows = df.withColumn("__w", T.words(F.col(body))).withColumn("__n", F.size("__w"))
    starts = F.when(F.col("__n") > longest, window_starts(F.col("__n"), window, overlap)).otherwise(F.array(F.lit(-1)))
    rows = rows.select("*", F.posexplode(starts).alias("part", "__s"))
    piece = F.array_join(F.slice("__w", F.col("__s") + 1, F.lit(window)), " ")
    rows = rows.withColumn(body, F.when(F.col("__s") >= 0, piece).otherwise(T.strip(F.col(body))))
    titled = F.when(F.col("__s") >= 0, F.concat(section, F.lit(":part_"), F.col("part").cast("string"))).otherwise(F.col(section))
    return rows.withColumn(section, titled).drop("__w", "__n", "__s")


def chunks(df: DataFrame, key: str = "paper_id", text: str = "text", longest: int = 1200, window: int = 600, overlap: int = 150) -> DataFrame:
    """``(chunk_id, paper_id, section, chunk_index, text, char_offset, word_count)`` of Markdown documents.

    Narrow: sections, windows and numbers of a document are made within its row, so no text is shuffled.
    """

    def numbered(list_: Column) -> Column:
        n = F.transform(list_, lambda p: T.word_count(p["body"]))
        sized = F.transform(F.arrays_zip(list_.alias("p"), n.alias("n")), lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"), F.when(x["n"] > longest, F.size(window_starts(x["n"], window, overlap))).otherwise(F.lit(1)).alias("parts")))

        def placed(every: Column) -> Column:
            sums = _with_sums(F.transform(every, lambda x: x["parts"]))
            return T.let(sums, lambda z: F.transform(every, lambda x, i: F.struct(x["p"].alias("p"), x["n"].alias("n"), _running(z, i).cast("int").alias("first"))))

        return T.let(sized, placed)

    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.explode(T.let(_section_list(F.col(text)), numbered)).alias("__x"))
    rows = rows.select(key, F.col("__x.p.section").alias("section"), F.col("__x.p.body").alias("body"), F.col("__x.p.char_offset").alias("char_offset"), F.col("__x.n").alias("__n"), F.col("__x.first").alias("__first"))
    long = F.col("__n") > longest
    starts = F.when(long, window_starts(F.col("__n"), window, overlap)).otherwise(F.array(F.lit(-1)))
    parts = rows.withColumn("__w", F.when(long, T.words(F.col("body")))).select("*", F.posexplode(starts).alias("part", "__s"))
    index = F.col("__first") + F.col("part")
    return parts.select(
        F.format_string("%s__%04d", F.col(key).cast("string"), index).alias("chunk_id"),
        F.col(key).alias("paper_id"),
        F.when(long, F.concat("section", F.lit(":part_"), F.col("part").cast("string"))).otherwise(F.col("section")).alias("section"),
        index.alias("chunk_index"),
        F.when(long, F.array_join(F.slice("__w", F.col("__s") + 1, F.lit(window)), " ")).otherwise(T.strip(F.col("body"))).alias("text"),
        "char_offset",
        F.when(long, F.least(F.lit(window), F.col("__n") - F.col("__s"))).otherwise(F.col("__n")).alias("word_count"),
    )
