"""Problem 7: encoding a whole corpus with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every prefix of a byte string exactly one token can be the last one of that
prefix's encoding. Scanning left to right, the last token of prefix ``i`` is the longest vocabulary token ``t`` that
ends at ``i`` and may stand after the last token of the prefix before it; two tokens may stand side by side exactly
when the merges would not have cut the boundary between them in another order. Following the stored last tokens back
from the end gives the encoding, in time linear in the bytes, however long a piece is. As the table of an unfinished
text stays valid when bytes are added, appends are exact and cheap (:class:`PrefixTable`), and an edit only needs the
pieces around it encoded again (:class:`EncodedText`).

The vocabulary file is a parameter (a rank file: one ``base64 rank`` pair a line); it is read on each executor.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: No character from here on is a letter or a number: unassigned, private use, tags and selectors.
PLANES_WITH_LETTERS = 0x40000
#: Pieces longer than this many characters are encoded without being remembered.
LONGEST_REMEMBERED = 40
#: Remembered pieces per Python worker; the table is emptied when it is full.
MOST_REMEMBERED = 300_000


# fixed values: the White_Space property
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file: in GRAPHLOOM_TOKENIZERS, /opt/tokenizers, or the installed package."""
    spec = importlib.util.find_spec("public_tokenizers")
    for folder in (os.environ.get("GRAPHLOOM_TOKENIZERS"), "/opt/tokenizers", spec and os.path.dirname(spec.origin)):
        if folder and os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    raise FileNotFoundError(name)


def _char_classes() -> tuple[str, str]:
    """The characters of the general categories L and N as ranges for regular-expression classes."""
    out: dict[str, list[str]] = {"L": [], "N": []}
    start, kind = 0, ""
    for c, k in enumerate(chain((category[0] for category in map(unicodedata.category, map(chr, range(PLANES_WITH_LETTERS)))), "-")):
        if k != kind:
            if kind in out:
                out[kind].append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start, kind = c, k
    return "".join(out["L"]), "".join(out["N"])


def piece_pattern() -> re.Pattern:
    """The public splitting rule of byte-level BPE vocabularies, with Unicode classes spelled out for ``re``.

    Letters and numbers stand first: no other alternative can match where they do, and most pieces are words.
    """
    letter, number = _char_classes()
    space = SPACE
    return re.compile(
        f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Vocabulary:
    """Ranks of a byte-level BPE, the two parts each token was merged from, and the test for neighbours."""

    def __init__(self, path: str):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        tails: dict[bytes, set[int]] = {}
        for token in self.rank:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {tail: (*sorted(n, reverse=True), 2, 1) for tail, n in tails.items()}  # that end in these bytes
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):  # only lower ranks are known at each step
            if len(token) == 1:
                self.parts[rank] = rank, rank
            else:
                self.parts[rank] = self._last_merge(token)
                self.merged[self.parts[rank]] = rank
        self._beside.clear()

    def _last_merge(self, token: bytes) -> tuple[int, int]:
        """The pair whose merge made the token: the one cut into two tokens that lower ranks leave side by side."""
        rank = self.rank
        pairs = [(rank[token[:i]], rank[token[i:]]) for i in range(1, len(token)) if token[:i] in rank and token[i:] in rank]
        whole = rank[token]
        pairs = [p for p in pairs if max(p) < whole]
        return pairs[0] if len(pairs) == 1 else next(p for p in pairs if self.beside(*p))

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves the boundary between them uncut.

        The merges along the boundary are undone from the latest; if some pair across it had an earlier rank than
        the merges that hid it, it would have been merged.
        """
        known = self._beside.get((left, right))
        if known is not None:
            return known
        key, merged, parts, limit, fits = (left, right), self.merged, self.parts, sys.maxsize, True
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                fits = False
                break
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    limit, inner = left, parts[left][1]
                    done = inner == left
                    left = inner
                else:
                    limit, inner = right + 1, parts[right][0]
                    done = inner == right
                    right = inner
                if not done:
                    break
                undo_left = not undo_left
            else:
                break
        if len(self._beside) >= 2_000_000:
            self._beside.clear()
        self._beside[key] = fits
        return fits


class PrefixTable:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []

    def append(self, more: bytes) -> PrefixTable:
        """Add bytes; the tokens of the prefixes so far stay as they are."""
        rank, beside, lengths, last = self.vocabulary.rank, self.vocabulary.beside, self.vocabulary.lengths, self.last
        self.data += more
        data = bytes(self.data)
        for end in range(len(last) + 1, len(data) + 1):
            for length in lengths.get(data[end - 3 : end] if end > 2 else b"", (2, 1)):
                start = end - length
                if start < 0:
                    continue
                token = rank.get(data[start:end])
                if token is not None and (not start or beside(last[start - 1], token)):
                    last.append(token)
                    break
        return self

    def ids(self) -> list[int]:
        out, at, length = [], len(self.last), self.vocabulary.token
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(length[token])
        return out[::-1]


class _Remembered(dict):
    """Ids by string, filled by ``make`` and emptied when full; long strings are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> list[int]:
        ids = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= MOST_REMEMBERED:
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Encodes texts; ``pieces`` holds the ids of pieces, ``words`` those of what stands between two single spaces."""

    def __init__(self, path: str):
        self.vocabulary, self.pattern = Vocabulary(path), piece_pattern()
        self.find = self.pattern.findall
        self.pieces = _Remembered(self._piece)
        self.words = _Remembered(lambda word: self.split_ids(" " + word))
        self.double = re.compile(r"\s ").search
        self.safe = re.compile(f"[^{SPACE}] (?=[^{SPACE}])").search

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.rank.get(data)  # a token's own bytes always encode to it
        return [whole] if whole is not None else PrefixTable(self.vocabulary).append(data).ids()

    def split_ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; the empty list for an empty or null text.

        A space after a character that is no white space always begins a piece, so the text may be cut there.
        """
        if not text:
            return []
        if self.double(text):
            return self.split_ids(text)
        first, *rest = text.split(" ")
        return self.split_ids(first) + list(chain.from_iterable(map(self.words.__getitem__, rest)))

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


class EncodedText:
    """A text with its ids, kept true under edits: an edit encodes what lies between the two nearest marks again.

    Marks are places where a piece begins whatever stands before or behind: spaces after a character that is no white
    space, one in about ``STRIDE`` characters. An edit can't move a mark whose two characters it doesn't touch, so the ids
    before the last mark in front of it and behind the first mark after it stay; their places are kept with the marks.
    """

    STRIDE = 256

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.ids = encoder, text, []
        self.marks, self.places = [0], [0]  # in characters, and in ids
        self._encode(text, self.marks, self.places, self.ids)

    def _encode(self, text: str, marks: list[int], places: list[int], ids: list[int]) -> None:
        """Append the ids of ``text``, and marks in it, to lists that end with a mark where it begins."""
        start, base, at = 0, marks[-1], places[-1]
        find = self.encoder.safe
        while (m := find(text, start + self.STRIDE)) is not None:
            cut = m.start() + 1
            part = self.encoder.encode(text[start:cut])
            ids += part
            at += len(part)
            marks.append(base + cut)
            places.append(at)
            start = cut
        ids += self.encoder.encode(text[start:])

    def edit(self, start: int, end: int, new: str) -> EncodedText:
        """Replace ``text[start:end]`` by ``new``."""
        k = max(0, bisect_left(self.marks, start) - 1)
        j = bisect_right(self.marks, end)
        left, right = self.marks[k], self.marks[j] if j < len(self.marks) else len(self.text)
        behind = self.places[j] if j < len(self.marks) else len(self.ids)
        marks, places, ids = [0], [0], []
        self._encode(self.text[left:start] + new + self.text[end:right], marks, places, ids)
        shift, moved = len(new) - (end - start), self.places[k] + len(ids) - behind
        self.text = self.text[:start] + new + self.text[end:]
        self.ids[self.places[k] : behind] = ids
        self.marks = self.marks[:k] + [left + m for m in marks] + [m + shift for m in self.marks[j:]]
        self.places = self.places[:k] + [self.places[k] + p for p in places] + [p + moved for p in self.places[j:]]
        return self


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(key, ids ARRAY<INT>)``, one row per input row, without special tokens.

    Null and empty texts give the empty list; a null key stays null; blank texts are encoded like any other; rows that
    repeat are encoded each; an empty table gives an empty table; other columns, whatever their names, don't matter.
    Narrow: no shuffle; the text is the only column besides the key that is read.
    """
    path = vocabulary or default_vocabulary()
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    wanted = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return wanted.mapInArrow(run, StructType([StructField(key, kind), StructField("ids", ArrayType(IntegerType()))]))


def token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with the number of tokens of it (0 for null or empty) as ``name``."""
    path = vocabulary or default_vocabulary()
    kept = [c for c in df.columns if c not in (text, name)]
    schema = StructType([df.schema[c] for c in kept] + [StructField(name, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = [encoder.count(t) for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n, pa.int32())], names=[*kept, name])

    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
