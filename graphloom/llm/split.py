"""Problem 5: cutting oversized items into overlapping pieces at natural boundaries.

Method: recursive bisection. A stretch of words longer than the limit minus the overlap is cut at the strongest
boundary near its midpoint (paragraph end, then sentence end, then line end, then any white space; the nearest of
equally strong ones), and both halves are treated alike. Cuts stay within a sixth of the stretch from its midpoint, so
every half has at least a third of its words. Where no paragraph or sentence ends there, the window is widened to a
third on either side and then to the whole stretch; only a stretch without any such end is cut at other white space, in
the narrow window (the first one not at all while it fits a piece, having no overlap). A gap without ends is cut off by
a few wide cuts, so the recursion stays logarithmic. Then each stretch but the first is extended backwards by the
overlap; for neighbours to share all of it no cut lies nearer to the start of the text than the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

WORD = re.compile(r"\S+")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")


# fixed values: abbreviations that a text goes on after
ABBREVIATIONS = frozenset("al approx ca cf dr eg eq eqs etc fig figs ie inc incl mr mrs ms no nos p pp prof ref refs resp sp spp st subsp suppl var viz vol vs".split())


def _abbreviated(word: str) -> bool:
    """Whether the full stop belongs to the word: a known abbreviation, or the initial of a name or a genus."""
    bare = word.rstrip("\"'”’»)]").lstrip("\"'“‘«([")
    return bare.endswith(".") and (bare.replace(".", "").lower() in ABBREVIATIONS or (len(bare) == 2 and bare[0].isupper()))


def boundary_strength(word: str, gap: str) -> int:
    """How natural a cut is after ``word`` when ``gap`` follows: paragraph 3, sentence 2, line 1, else 0."""
    if PARAGRAPH.search(gap):
        return 3
    if (SENTENCE.search(word) and not _abbreviated(word)) or word[-1:] in "。！？":
        return 2
    return 1 if "\n" in gap else 0


def bisect(text: str, limit: int = 600, overlap: int = 150) -> list[tuple[int, int, int, int]]:
    """Pieces ``(first char, end char, first word, end word)`` of the text, in order, each of at most ``limit`` words.

    Consecutive pieces share exactly ``overlap`` words. Blank text has no pieces; text within the limit has one.
    """
    if not 0 <= overlap * 4 <= limit:
        raise ValueError("the overlap may be a quarter of the limit at most")
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) <= limit:
        return [(spans[0][0], spans[-1][1], 0, len(spans))] if spans else []
    core, cuts, open_ = limit - overlap, [], [(0, len(spans))]
    while open_:
        start, end = open_.pop()
        if end - start <= core:
            continue
        middle, size = (start + end) // 2, end - start
        least = max(start + 1, overlap)

        def strongest(reach: int) -> tuple[int, int, int]:
            window = range(max(least, middle - reach), min(end - 1, middle + reach) + 1)
            return max((boundary_strength(text[slice(*spans[i - 1])], text[spans[i - 1][1] : spans[i][0]]), -abs(i - middle), -i) for i in window)

        narrow = max(1, size // 6)
        found = next((f for f in map(strongest, (narrow, size // 3, size)) if f[0] > 1), None)
        if found is None and not start and end <= limit:
            continue
        best = -(found or strongest(narrow))[2]
        cuts.append(best)
        open_ += [(start, best), (best, end)]
    edges = [0, *sorted(cuts), len(spans)]
    pieces = [(max(0, a - overlap) if a else 0, b) for a, b in zip(edges, edges[1:])]
    return [(spans[a][0], spans[b - 1][1], a, b) for a, b in pieces]


def split_oversized(
    df: DataFrame,
    key: str = "chunk_id",
    text: str = "text",
    offset: str = "char_offset",
    carried: tuple[str, ...] = ("paper_id", "section"),
    oversize: int = 1200,
    limit: int = 600,
    overlap: int = 150,
) -> DataFrame:
    """Pieces of the rows whose text has more than ``oversize`` words; shorter, blank and null texts give none.

    ``(key, *carried, piece_index, n_pieces, char_offset, n_words, text)``: ``char_offset`` is the row's offset plus
    the place of the piece in it, in code points (null where the row's is null); ``text`` is the piece as it stands.
    A null key stays null; repeated rows give their pieces each time; other columns don't matter. Narrow: rows that
    can't exceed the limit by their length alone never leave the JVM.
    """
    fields = [df.schema[key], *[df.schema[c] for c in carried]]
    schema = StructType([*fields]).add("piece_index", IntegerType()).add("n_pieces", IntegerType()).add("char_offset", LongType()).add("n_words", IntegerType()).add("text", StringType())
    n = 1 + len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                take, out = [], ([], [], [], [], [])
                for row, (base, body) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist())):
                    pieces = bisect(body, limit, overlap) if len(body.split()) > oversize else []
                    for i, (start, end, first, last) in enumerate(pieces):
                        take.append(row)
                        for column, value in zip(out, (i, len(pieces), None if base is None else base + start, last - first, body[start:end])):
                            column.append(value)
                index = pa.array(take, pa.int64())
                kept = [part.column(c).take(index) for c in range(n)]
                made = [pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    long_enough = df.where(F.length(text) > 2 * oversize)  # n words need n - 1 gaps
    return long_enough.select(key, *carried, F.col(offset).cast("long").alias("__offset"), F.col(text).alias("__text")).mapInArrow(run, schema)
