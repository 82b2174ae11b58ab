"""Problem 6: repairing text of scanned pages into continuous paragraphs, and reporting each defect.

Method: heads and feet are lines that repeat, fuzzily, at page edges. A line can be one if it stands out (set in, in
capitals or short) and is no part of a sentence; it stands at a page's edge if it interrupts a sentence, is set in, or
lies beside a form feed, a page number or another such line. Lines are folded (case, digits, and all characters that
recognition confuses become one); a folded line that several texts, or two of the same paper, share is a head if most of
them have it at an edge, so a heading of the text itself is none, however often it comes. The paper's title counts as one
more repetition. Page numbers are lines of the customary forms; a bare number or Roman
numeral must be at an edge or apart from the text, and what may be a year both, or rise from page to page. (Chunks hold a
page or two, so a rising sequence can't be the only evidence.)
What is left is joined: a word broken at a line's end loses the hyphen unless the corpus writes it with one, and words
that the corpus hardly has are read again by the confusions of recognition.

The vocabulary counts the words of all chunks; the words that come LEAST_COUNT times are broadcast, of more than
``MOST_WORDS`` the commonest. The others come to the texts that ask for them by a join: whatever a text looks up has the
strokes of one of its forms, so the words of those strokes (``place_of``) are all that it needs, and where words are held changes no
result. Everything else moves only for chunks whose lines break within sentences.
"""

from __future__ import annotations

import re
import uuid
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from graphloom.plans.stage import not_broadcast, staged

#: Bound of the broadcast vocabulary (some 100 MB a worker), least count of a word in it, and how much commoner the right word must be.
MOST_WORDS, LEAST_COUNT, RATIO = 1_000_000, 4, 30
#: Different texts, of all and of one paper, that must share a folded line for it to be a head, and least letters of one.
REPEATED, REPEATED_IN_PAPER, LEAST_HEAD = 3, 2, 10

# fixed values: what recognition writes, and what stood there
CONFUSIONS = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("c", "e"), ("l", "i"), ("f", "t"), ("o", "a"), ("q", "g"), ("m", "rn"), ("d", "cl"))
# fixed values: characters and pairs that recognition can't tell apart, each as one of them
ALIKE = str.maketrans({"0": "a", "o": "a", "1": "i", "l": "i", "5": "s", "6": "b", "c": "e", "f": "t", "q": "g"})
PAIRS = re.compile("rn|ri|cl|ii|li|vv|ﬁ|ﬂ")
PAIR = {"rn": "m", "ri": "n", "cl": "d", "ii": "u", "li": "h", "vv": "w", "ﬁ": "fi", "ﬂ": "fl"}

# fixed values: what each character is made of, where characters that recognition confuses are one
STROKES = str.maketrans({"0": "a", "o": "a", "1": "i", "l": "i", "5": "s", "6": "b", "c": "e", "f": "t", "q": "g", "n": "ri", "m": "rri", "d": "ei", "u": "ii", "h": "ii", "w": "vv", "ﬁ": "ti", "ﬂ": "ti"})
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
NUMBER = re.compile(r"(?:p[ao]ge\s+\S*\d\S*(?:\s+[oa0]f\s+\S*\d\S*)?|pp?\.?\s*\d+|[-–—]+\s*\d+\s*[-–—]+|[\[(]\s*\d+\s*[\])]|\d+\s*\||\|\s*\d+|[a-z]?\d{1,5}|[ivxlc]{1,8})", re.I)
BESIDE = re.compile(r"^\s*\d+\s{2,}|\s{2,}\d+\s*$")
BROKEN = re.compile(r"(\S*[^\W_])[-\u00ad\u00ac\u2010\u2011]$")
EDGE = "\"'“”‘’«»()[]{}.,;:!?…"
SUSPENDED = {"and", "or", "to", "und", "oder", "et", "y", "e"}
#: For the JVM: a line that ends within a sentence, before another line.
WITHIN = r"[^\s.!?:|\"»)]\r?\n[ \t\f]*\S"


def fold(line: str) -> str:
    """A line without what recognition confuses: equal for a head and its misread, renumbered or re-cased copies."""
    low = re.sub(r"[\W_]+", " ", line.lower()).strip()
    low = " ".join("#" if w.isdigit() else w for w in low.split())
    return PAIRS.sub(lambda m: PAIR[m.group()], low).translate(ALIKE)


def word_of(token: str) -> str:
    return token.strip(EDGE).lower()


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n\f\n").split("\n")


def wrapped(lines: list[str]) -> bool:
    """Whether lines break within sentences more often than at their ends."""
    full = [s for s in (line.strip() for line in lines) if s and s != "\f" and s[0] != "|"]
    inside = sum(s.rstrip("\"'”’»)")[-1:] not in tuple(".!?:;") for s in full[:-1])
    return len(full) > 1 and 2 * inside >= len(full) - 1


def suspects(lines: list[str]) -> list[int]:
    """Lines that stand out at the edge of a page: set in, in capitals or short, and no page number."""
    full = [len(line.rstrip()) for line in lines if line.strip()]
    width = sorted(full)[int(0.8 * len(full))] if full else 0
    out = []
    for i, line in enumerate(lines):
        body = BESIDE.sub("", line).strip()
        if sum(c.isalpha() for c in body) < LEAST_HEAD or NUMBER.fullmatch(line.strip()):
            continue
        set_in = len(line) - len(line.lstrip()) >= 3 or bool(BESIDE.search(line))
        capital = body.upper() == body
        short = len(line.rstrip()) <= 0.85 * width
        if (set_in or capital or short) and body.count("|") < 2:
            out.append(i)
    return out


def body_of(line: str) -> str:
    """A line without a page number beside it and white space around it."""
    return BESIDE.sub("", line).strip()


def stands_alone(body: str) -> bool:
    """Whether a line neither begins nor ends like a part of a sentence."""
    first = next((c for c in body if c.isalpha()), "a")
    return bool(body) and not first.islower() and (body[-1].isalnum() or body[-1] in ")]|")


def number_like(body: str) -> bool:
    """Whether a line has a customary form of a page number; letters must make a Roman numeral."""
    return bool(NUMBER.fullmatch(body)) and not (body.isalpha() and len(body) > 0 and not ROMAN.fullmatch(body))


@dataclass
class Page:
    """The lines of a text, with those that may be furniture and the evidence for each."""

    lines: list[str]
    kind: list[str]  # "" text, "_" blank, "f" form feed, "n" like a page number, "s" standing out
    edge: list[bool]
    apart: list[bool]
    flows: list[bool]  # begins a sentence that the next line goes on with

    @staticmethod
    def of(lines: list[str]) -> Page:
        odd = set(suspects(lines))
        kind = []
        for i, line in enumerate(lines):
            body = line.strip()
            kind.append("f" if body == "\f" else "_" if not body else "n" if number_like(body) else "s" if i in odd else "")
        n = len(lines)
        loose = [k == "n" or (k == "s" and stands_alone(body_of(line))) for k, line in zip(kind, lines)]
        before, after, last = [""] * n, [False] * n, ""
        for i in range(n):
            before[i] = last
            if not loose[i] and kind[i] in ("", "s"):
                last = lines[i].strip()
        seen = False
        for i in reversed(range(n)):
            after[i] = seen
            seen |= not loose[i] and kind[i] in ("", "s")
        set_in = [len(line) - len(line.lstrip()) >= 3 for line in lines]
        around = lambda i: [j for j in range(max(0, i - 2), min(n, i + 3)) if j != i]
        within = [bool(before[i]) and after[i] and before[i].rstrip("\"'”’»)")[-1:] not in tuple(".!?:") for i in range(n)]
        own = [set_in[i] or bool(BESIDE.search(lines[i])) or lines[i].upper() == lines[i] for i in range(n)]
        flows = [not within[i] and not own[i] and i + 1 < n and kind[i + 1] in ("", "s") and lines[i + 1].lstrip()[:1].islower() for i in range(n)]
        edge = [loose[i] and (kind[i] == "n" or not flows[i]) and (within[i] or set_in[i] or bool(BESIDE.search(lines[i])) or any(kind[j] in "fn" for j in around(i) if kind[j])) for i in range(n)]
        edge = [edge[i] or (loose[i] and (kind[i] == "n" or not flows[i]) and any(edge[j] for j in around(i))) for i in range(n)]
        blank = lambda j: not 0 <= j < n or kind[j] in ("_", "f")
        apart = [set_in[i] or blank(i - 1) or blank(i + 1) or any(kind[j] == "n" or (edge[j] and kind[j] == "s") for j in around(i)) for i in range(n)]
        return Page(lines, kind, edge, apart, flows)

    def candidates(self) -> list[tuple[str, bool, bool]]:
        """``(folded line, whether it stands alone, whether at an edge)`` of the lines that stand out."""
        rows = zip(self.lines, self.kind, self.edge, self.flows)
        return [(fold(body_of(line)), stands_alone(body_of(line)), edge) for line, kind, edge, flows in rows if kind == "s" and not flows]

    def numbers(self) -> set[int]:
        """The lines that are page numbers."""
        found, last = set(), None
        for i, line in enumerate(self.lines):
            if self.kind[i] != "n":
                continue
            body = line.strip()
            value = int("".join(c for c in body if c.isdigit())[:9] or 0)
            rises = last is not None and 0 < value - last <= 50
            last = value or last
            year = body.isdigit() and 1500 <= value < 2100
            sure = not body.isalnum()  # a number with something around it that only page numbers have
            if sure or rises or (self.edge[i] and self.apart[i]) or (not year and (self.edge[i] or self.apart[i])):
                found.add(i)
        return found


def begins_title(key: str, title: str) -> bool:
    """Whether a folded line is the beginning of a folded title, both without spaces; its last characters may be cut or misread."""
    return len(key) >= LEAST_HEAD and title.startswith(key[:-2]) and len(key) <= len(title) + 2


class Reader:
    """Repairs texts with the words of the corpus; ``names`` are words that only names have, which are left alone."""

    def __init__(self, vocabulary: dict[str, int], names: set[str] = frozenset()):
        self.count, self.names, self.known = vocabulary, names, {}
        self.alike: dict[str, list[str]] = {}
        for word in vocabulary:
            if not any(c.isdigit() for c in word):
                self.alike.setdefault(word.translate(STROKES), []).append(word)

    def right(self, word: str) -> str | None:
        """The common word that a rare one is a misreading of."""
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = self._right(word)
        return self.known[word]

    def _right(self, word: str) -> str | None:
        """Of the common words of the same strokes the one that the fewest confusions, three at most, lead to."""
        least = max(LEAST_COUNT, RATIO * self.count.get(word, 0))
        if len(word) < (2 if any(c.isdigit() for c in word) else 3) or word.isdigit():
            return None
        fit = {w for w in self.alike.get(word.translate(STROKES), ()) if w != word and self.count[w] >= least}
        level, seen = {word} if fit else set(), {word}
        for _ in range(3):
            after = set()
            for w in level:
                for wrong, was in CONFUSIONS:
                    at = w.find(wrong)
                    while at >= 0:
                        after.add(w[:at] + was + w[at + len(wrong) :])
                        at = w.find(wrong, at + 1)
            level = after - seen
            seen |= level
            found = level & fit
            if found:
                return max((self.count[w], w) for w in found)[1]
        return None

    def repair(self, text: str, heads: set[str]) -> tuple[str, list[tuple[str, str]]]:
        """The text in continuous paragraphs, and the defects ``(kind, item)`` in order; ``heads`` are folded lines."""
        lines = lines_of(text)
        found: list[tuple[str, str]] = []
        if not wrapped(lines):
            return "\n\n".join(p for p in (re.sub(r"[ \t]*\n[ \t]*", "\n", b).strip() for b in re.split(r"\n\s*\n", "\n".join(lines).replace("\f", ""))) if p), []
        page = Page.of(lines)
        numbers = page.numbers()
        kept: list[str] = []
        for i, line in enumerate(lines):
            body = line.strip()
            if body == "\f":
                kept.append("\f")
            elif i in numbers:
                found.append(("page_number", body))
                kept.append("\f")
            elif page.kind[i] == "s" and not page.flows[i] and fold(body_of(line)) in heads:
                found.append(("running_head", body))
                kept.append("\f")
            else:
                kept.append(body)
        # what stands between two parts of one sentence is no paragraph's end
        paragraphs: list[list[str]] = [[]]
        pages = False
        for body in kept:
            if body in ("", "\f"):
                pages |= body == "\f"
                if paragraphs[-1] and body == "":
                    paragraphs.append([])
                continue
            if len(paragraphs) > 1 and not paragraphs[-1] and pages and not re.search(r"[.!?:][\"'”’»)]*$", paragraphs[-2][-1]):
                paragraphs.pop()
            paragraphs[-1].append(body)
            pages = False
        out = [" ".join(self._joined(p, found)) for p in paragraphs if p]
        return "\n\n".join(out), found

    def _joined(self, lines: list[str], found: list[tuple[str, str]]) -> list[str]:
        words: list[str] = []
        broken = ""
        for line in lines:
            parts = line.split()
            if broken and parts:
                parts[0] = self._whole(broken, parts[0], found)
            broken = ""
            if parts and BROKEN.fullmatch(parts[-1]):
                broken = parts.pop()
            words += [self._read(p, found) for p in parts]
        return words + ([broken] if broken else [])

    def _whole(self, left: str, right: str, found: list[tuple[str, str]]) -> str:
        """A word from its two halves, with its own hyphen if the corpus writes it so."""
        left = left[:-1]
        tail = word_of(right)
        if tail in SUSPENDED and word_of(left) + tail not in self.count:
            return f"{left}- {right}"
        one, two = word_of(left + right), word_of(left + "-" + right)
        options = [(self.count.get(one, 0), one, left + right), (self.count.get(two, 0), two, left + "-" + right)]
        best = max(options, key=lambda o: (o[0], o[2] == left + right))
        if best[0] < LEAST_COUNT:
            read = [(self.count[r], r, w, o) for _, w, o in options if (r := self.right(w))]
            if read:
                n, r, w, o = max(read)
                self._report("split_word", r, found)
                self._report("misread", r, found)
                return _recased(o, w, r)
            return left + ("-" if re.search(r"\d$|^\d", left[-1:] + right[:1]) else "") + right
        self._report("split_word", best[1], found)
        return best[2] if best[2] == left + right else left + "-" + right

    def _read(self, token: str, found: list[tuple[str, str]]) -> str:
        word = word_of(token)
        if not word or self.count.get(word, 0) >= 1000 * LEAST_COUNT or word.isdigit():
            return token
        right = self.right(word)
        if right is None and "-" in word:
            parts = [(p, None if len(p) < 3 else self.right(p)) for p in word.split("-")]
            fixed = [r for _, r in parts if r and r not in self.names]
            if fixed and self.count.get(word, 0) < LEAST_COUNT:
                for r in fixed:
                    self._report("misread", r, found)
                return _recased(token, word, "-".join(r or p for p, r in parts))
        if right is None or right in self.names:
            return token
        self._report("misread", right, found)
        return _recased(token, word, right)

    def _report(self, kind: str, item: str, found: list[tuple[str, str]]) -> None:
        if item not in self.names:
            found.append((kind, item))


class _Either:
    """What is in one of two sets."""

    def __init__(self, one: set[str], other: set[str]):
        self.one, self.other = one, other

    def __contains__(self, x: str) -> bool:
        return x in self.one or x in self.other


class ReaderOfText(Reader):
    """A reader for one text, with the words ``(word, n, only names have it)`` that the common one doesn't hold."""

    def __init__(self, common: Reader, more: list[dict]):
        super().__init__({r["word"]: r["n"] for r in more})
        self.count = ChainMap(self.count, common.count)
        self.names = _Either({r["word"] for r in more if r["name"]}, common.names)
        self.alike = ChainMap({k: [*common.alike.get(k, ()), *v] for k, v in self.alike.items()}, common.alike)
        self.known = common.known  # a place is given whole or has no rarer words, so every text reads a word alike


def place_of(word: str) -> str:
    """What words share that may be looked up for one another: their strokes, without hyphens, as a line's end may add one."""
    return word.translate(STROKES).replace("-", "")


class Asked(Reader):
    """Collects the places of all that :meth:`Reader.repair` may look up for a text, whatever the vocabulary; ``longest`` is that of its places."""

    def __init__(self, longest: int):
        super().__init__({})
        self.longest, self.places, self.atoms = longest, set(), {}

    def _add(self, *words: str) -> None:
        for word in words:
            self.places.update(p for w in {word, *word.split("-")} if 0 < len(p := place_of(w)) <= self.longest)

    def _whole(self, left: str, right: str, found: list[tuple[str, str]]) -> str:
        """Any hyphen between the parts of a word may stay or go, so what stands between two of them is any run of parts."""
        atoms = [*self.atoms.get(left, [left])]
        atoms[-1] = atoms[-1][:-1]
        left = left[:-1]
        self._add(word_of(left) + word_of(right), word_of(left + right), word_of(left + "-" + right))
        end = ""
        for atom in reversed(atoms):  # runs that end with the first piece of the new part
            end = atom.rpartition("-")[2] + end
            self._add(word_of(end + right.partition("-")[0]))
            if "-" in atom or len(end) > self.longest:
                break
        self.atoms[left + right] = [*atoms, right]
        return left + right

    def _read(self, token: str, found: list[tuple[str, str]]) -> str:
        self._add(word_of(token))
        return token


def _recased(token: str, word: str, right: str) -> str:
    """``right`` in the place and case that ``word`` has in the token."""
    at = token.lower().find(word)
    if at < 0:
        return right
    own = token[at : at + len(word)]
    if own.upper() == own and own.lower() != own and sum(c.isalpha() for c in own) > 1:
        right = right.upper()
    elif own[:1].isupper():
        right = right[:1].upper() + right[1:]
    return token[:at] + right + token[at + len(word) :]


_made: dict[str, Reader] = {}


def reader_for(token: str, vocabulary: dict[str, int], names: set[str]) -> Reader:
    """The reader of this process for one vocabulary, with the words it has seen; made by the first task."""
    if token not in _made:
        _made.clear()
        _made[token] = Reader(vocabulary, names)
    return _made[token]


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all texts: runs between white space, lower-cased, without punctuation at their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter = Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for token, n in raw.items():
                words[word_of(token)] += n
            del words[""]
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            raw.update(chain.from_iterable(t.split() for t in batch.column(0).to_pylist()))
            if len(raw) > 500_000:
                yield out()
                raw.clear()
        yield out()

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    return df.where(F.length(text) > 0).select(text).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def common_words(df: DataFrame, text: str = "text", entities: DataFrame | None = None) -> tuple[dict[str, int], set[str], DataFrame | None]:
    """The words that come LEAST_COUNT times, of more than MOST_WORDS the commonest; those of them that only names have; the other words.

    The others are a table ``(word, n, name, place)``, None if there are none; ``name`` tells whether only names have it. Names matter only where they are in the vocabulary, which bounds both.
    """
    counts = staged(word_counts(df, text), "words")
    known = counts.where(F.col("n") >= LEAST_COUNT)
    rarer = None
    if known.count() > MOST_WORDS:
        by_count = known.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))  # a row per different count
        upto = by_count.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n"))))
        least = upto.where(F.col("upto") <= MOST_WORDS).agg(F.min("n")).first()[0] or 1 << 62
        rarer, known = known.where(F.col("n") < least), known.where(F.col("n") >= least)
    of_names = None if entities is None else name_words(entities).select(F.col("w").alias("word"))
    names = set() if of_names is None else {r[0] for r in known.join(of_names, "word", "left_semi").select("word").collect()}
    if rarer is not None:
        flagged = rarer.withColumn("name", F.lit(False)) if of_names is None else rarer.join(of_names.withColumn("name", F.lit(True)), "word", "left").withColumn("name", F.coalesce("name", F.lit(False)))
        rarer = staged(_with_places(flagged), "rarer")
    return {r[0]: r[1] for r in known.collect()}, names, rarer  # at most MOST_WORDS


def _with_places(words: DataFrame) -> DataFrame:
    """``words (word, n, name)`` with the ``place`` of each."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType()), StructField("name", BooleanType()), StructField("place", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array([place_of(w) for w in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, places], names=schema.names)

    return words.select("word", "n", "name").mapInArrow(run, schema)


def _with_rarer(texts: DataFrame, rarer: DataFrame) -> DataFrame:
    """``texts (key, text, heads)`` with ``more``, the rarer words ``(word, n, name)`` of the places that a text asks for."""
    schema = StructType([texts.schema["key"], StructField("place", StringType())])
    longest = rarer.agg(F.max(F.length("place"))).first()[0] or 0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            at, places = [], []
            for i, (text, heads) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2)))):
                asked = Asked(longest)
                asked.repair(text, set(heads or ()))
                at += [i] * len(asked.places)
                places += asked.places
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.string())], names=schema.names)

    asked = texts.mapInArrow(ask, schema).join(not_broadcast(rarer), "place")
    more = asked.groupBy("key").agg(F.collect_list(F.struct("word", "n", "name")).alias("more"))  # of the words of one text
    return texts.join(more, "key", "left")


def name_words(entities: DataFrame) -> DataFrame:
    """``w``: words that few entity names have."""
    words = entities.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), F.col("name").alias("of"))
    words = words.select(F.explode(F.split(F.lower("name"), r"[\s,/]+")).alias("w"), "of")
    words = words.unionByName(words.select(F.explode(F.split("w", "-")).alias("w"), "of"))
    return words.where("w <> ''").groupBy("w").agg(F.count_distinct("of").alias("n")).where("n < 4").select("w")


def _title_heads(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """``(key, line)`` of the lines that begin a title of their paper; joined by its first characters, so papers of many titles are no group."""
    schema = StructType([StructField("paper", StringType()), StructField("start", StringType()), StructField("title", StringType())])
    start = LEAST_HEAD - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [fold(t).replace(" ", "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[:start] for t in folded], pa.string()), pa.array(folded, pa.string())], names=schema.names)

    folded = titles.where("title IS NOT NULL AND paper_id IS NOT NULL").select(F.col("paper_id").cast("string"), "title").mapInArrow(run, schema).distinct()
    own = lines.select("key", "paper", "line", F.replace("line", F.lit(" "), F.lit("")).alias("__l")).withColumn("start", F.substring("__l", 1, start))
    fits = (F.length("__l") >= LEAST_HEAD) & F.startswith("title", F.expr("left(__l, length(__l) - 2)")) & (F.length("__l") <= F.length("title") + 2)
    return own.join(folded, ["paper", "start"]).where(fits).select("key", "line")


def repair_scans(df: DataFrame, titles: DataFrame | None = None, entities: DataFrame | None = None, key: str = "chunk_id", paper: str = "paper_id", text: str = "text") -> DataFrame:
    """``(key, text, defects ARRAY<STRUCT<defect, item>>)`` of the rows whose lines break within sentences.

    Other texts, null, empty and blank ones are continuous already and give no rows. A key that comes several times
    counts once; null keys are left out; a null paper has no title; ``titles (paper_id, title)`` may hold several
    titles of a paper, or be missing; words that only names of ``entities (name, aliases)`` have are left alone; other
    columns don't matter; an empty table gives no rows. The vocabulary is counted by jobs that run at once.
    """
    spark = df.sparkSession
    words, names, rarer = common_words(df, text, entities)
    vocabulary = spark.sparkContext.broadcast((uuid.uuid4().hex, words, names))
    line = pa.struct([("line", pa.string()), ("alone", pa.bool_()), ("edge", pa.bool_())])
    kinds = ArrayType(StructType([StructField("line", StringType()), StructField("alone", BooleanType()), StructField("edge", BooleanType())]))
    found_schema = StructType([StructField("key", df.schema[key].dataType), StructField("paper", StringType()), StructField("text", StringType()), StructField("lines", kinds)])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                lines = lines_of(t)
                if wrapped(lines):
                    rows.append(i)
                    found.append([{"line": l, "alone": a, "edge": e} for l, a, e in Page.of(lines).candidates()])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(found, pa.list_(line))], names=found_schema.names)

    broken = df.where(F.col(key).isNotNull() & F.col(text).rlike(WITHIN)).select(F.col(key), F.col(paper).cast("string"), F.col(text))
    scans = staged(broken.mapInArrow(pick, found_schema).dropDuplicates(["key"]), "scans")
    lines = scans.select("key", "paper", F.xxhash64("text").alias("t"), F.explode("lines").alias("__l")).select("key", "paper", "t", "__l.*")
    by_text = lines.where("alone").groupBy("line", "paper", "t").agg(F.max("edge").alias("edge"))

    def shared(by: list[str], least: int) -> DataFrame:
        once = by_text.groupBy(*by, "t").agg(F.max("edge").alias("edge")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("edge"), 1)).alias("edges"))
        return once.where((F.col("n") >= least) & (2 * F.col("edges") >= F.col("n"))).select(*by)

    alone = lines.where("alone").select("key", "paper", "line")
    heads = alone.join(shared(["line"], REPEATED), "line", "left_semi").select("key", "line")
    heads = heads.unionByName(alone.join(shared(["paper", "line"], REPEATED_IN_PAPER), ["paper", "line"], "left_semi").select("key", "line"))
    if titles is not None:
        heads = heads.unionByName(_title_heads(lines, titles))
    joined = scans.drop("lines").join(heads.groupBy("key").agg(F.collect_set("line").alias("heads")), "key", "left")  # lines of one text
    defect = StructType([StructField("defect", StringType()), StructField("item", StringType())])
    out = StructType([StructField(key, df.schema[key].dataType), StructField("text", StringType()), StructField("defects", ArrayType(defect))])
    kind = pa.list_(pa.struct([("defect", pa.string()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_for(*vocabulary.value)
        for batch in batches:
            done = []
            for t, h, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = ReaderOfText(reader, more.as_py()) if more.is_valid else reader  # the words of one text at a time
                done.append(own.repair(t, set(h or ())))
            defects = pa.array([[{"defect": d, "item": i} for d, i in f] for _, f in done], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), defects], names=out.names)

    asked = joined.select("key", "text", "heads")
    none = F.lit(None).cast("array<struct<word: string, n: bigint, name: boolean>>")
    asked = asked.withColumn("more", none) if rarer is None else _with_rarer(staged(asked, "asked"), rarer)
    return asked.select("key", "text", "heads", "more").mapInArrow(run, out)


def defects(repaired: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, defect, item)``: each defect of a row once."""
    return repaired.select(key, F.explode(F.array_distinct("defects")).alias("d")).select(key, "d.defect", "d.item")
