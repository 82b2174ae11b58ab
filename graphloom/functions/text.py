r"""Text functions as Column expressions, with one notion of white space in every engine.

``\s`` is ASCII in Java and RE2; ``WS`` also holds the Unicode separators and the control characters that a
Unicode-aware ``strip`` or ``split`` removes. Texts are expected with ``\n`` line ends: see :func:`newlines`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
LINE_END = r"[\n\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# fixed values: what a header and a figure's caption look like
HEADER = rf"(?md)^(#{{2,6}}{WS}+.+|(?:\*\*[^*\n]+\*\*){WS}*)$"
CAPTION = rf"(?mid)^(fig(?:ure)?\.?{WS}*\d+[a-zA-Z]?[.:–\-]?{WS}*.{{0,200}})$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def newlines(text: Column) -> Column:
    """Every line end as one line feed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def words(text: Column) -> Column:
    """The runs of other characters than white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    """The lines; a line end at the end begins no line."""
    return let(F.split(text, LINE_END), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def without_repeated_lines(text: Column, more_than: int = 3, shorter_than: int = 120, fewer_words: int = 15) -> Column:
    """Running heads and feet removed: short lines that stand more than ``more_than`` times in one text.

    The sorted lines are compared with those ``more_than`` places on, so a long text costs n log n.
    """

    def noise(ordered: Column) -> Column:
        many = F.when(F.size(ordered) > more_than, F.sequence(F.lit(1), F.size(ordered) - more_than)).otherwise(F.array().cast("array<int>"))
        repeated = F.array_distinct(F.transform(F.filter(many, lambda i: F.element_at(ordered, i) == F.element_at(ordered, i + more_than)), lambda i: F.element_at(ordered, i)))
        return F.filter(repeated, lambda s: (F.length(s) < shorter_than) & ~F.startswith(s, F.lit("#")) & (word_count(s) < fewer_words))

    def kept(pairs: Column) -> Column:
        ordered = F.array_sort(F.filter(F.transform(pairs, lambda p: p["s"]), lambda s: s != ""))
        without = let(let(ordered, noise), lambda n: F.filter(pairs, lambda p: ~F.array_contains(n, p["s"])))
        return F.array_join(F.transform(without, lambda p: p["line"]), "\n")

    return let(F.transform(lines(text), lambda x: F.struct(x.alias("line"), strip(x).alias("s"))), kept)


def quoted_captions(text: Column) -> Column:
    """Figure captions as block quotes."""
    return F.regexp_replace(text, CAPTION, "> $1")


def collapsed_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def with_title(text: Column, stem: Column) -> Column:
    """A top-level header made from the document's name, unless there is one."""
    head = F.concat(F.lit("# "), title_case(F.regexp_replace(stem, "[_-]", " ")), F.lit("\n\n"))
    return F.when(F.startswith(F.regexp_replace(text, rf"\A{WS}+", ""), F.lit("# ")), text).otherwise(F.concat(head, text))


def cleaned_markdown(text: Column, stem: Column) -> Column:
    """The four clean-up passes in order."""
    return let(collapsed_blanks(quoted_captions(without_repeated_lines(text))), lambda t: with_title(t, stem))


def caps_headings(text: Column, shorter_than: int = 80) -> Column:
    """Short lines in capitals as second-level headings."""

    def heading(line: Column) -> Column:
        return let(strip(line), lambda s: shown(s, line))

    def shown(s: Column, line: Column) -> Column:
        capital = (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) < shorter_than)
        return F.when(capital, F.concat(F.lit("## "), title_case(s))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), heading), "\n")


def title_of(text: Column, stem: Column) -> Column:
    """The first top-level header, or else the document's name."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, rf"(?md)^#{WS}+(.+)$", 1)), F.lit("")), stem)


def clean_header(header: Column) -> Column:
    h = F.regexp_replace(strip(header), rf"\A#{{2,6}}{WS}+", "")
    return strip(F.regexp_replace(h, r"\A\*\*(.+)\*\*\z", "$1"))


def normal_name(name: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces."""
    spaced = F.regexp_replace(F.lower(name), rf"[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85]", " ")
    return strip(F.regexp_replace(spaced, WS + "+", " "))
