"""Problem 1: mapping freely written values to the entries of a canonical list, and reporting what stands for none.

Method: BK-trees over the forms of the reference entries under Levenshtein distance; every mapping comes out of a tree.
A value is folded (case, quotes, spacing, Greek letters) and read in some ways (without qualifiers, doses, inversions).
Each reading is searched for with threshold 0, mildest first, and then with threshold 2; the triangle inequality prunes
the tree and every form within the threshold comes back. How much of that a form allows follows from its length: one
edit (a swap of neighbours counts as one) for words of five letters or more, two for long ones if they lead to one
entry only, none for symbols and codes, where another letter names another thing; and numbers must be equal always.

Forms are names, listed aliases, and short forms by the ``Conventions`` of the field, where these are unambiguous over
the whole list. They are worked out once, as a table. While it is small (``MOST_FORMS``, counted first) it is broadcast;
a longer one is sharded by a hash of the form, each distinct value is searched for in all shards, and the shards'
winners are merged in the same order of preference, so both ways give the same.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.bktree import BKTree, Pattern, one_edit
from graphloom.plans.stage import staged

#: Forms that the broadcast trees may hold; longer lists are sharded.
MOST_FORMS = 200_000
#: Values remembered per Python worker.
MOST_REMEMBERED = 200_000
#: Letters a form needs for one edit and for two, and how many entries a word must occur in to be a common one.
SHORT, WORD, LONG, COMMON = 5, 8, 12, 4

# fixed values: names of the Greek letters, and Roman numerals
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma sigma tau upsilon phi chi psi omega".split()))
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
DOSE = re.compile(r"\s+\d+(?:[.,]\d+)?\s*(?:mg|g|kg|ml|l|µg|μg|mcg|ng|iu)$", re.I)
BRACKET = re.compile(r"\s*[(\[][^()\[\]]*[)\]]$")
TOKEN = re.compile(r"[^\W\d_]+\.?|\d+|\+|/")

#: Ranks of forms: names before listed aliases before derived ones.
NAME, LISTED, DERIVED = 0, 1, 2


@dataclass(frozen=True)
class Conventions:
    """How a field writes its names; a parameter of the operator. The defaults are those of biomedical texts.

    ``qualifiers`` may stand behind a name without changing what it names. ``short`` are patterns of short forms for
    names of one rare word ``{w}`` and common ones, by the name's last word or the rare word's ending ("" is any);
    ``pair`` those for two rare words; ``numbered`` those for families like ``stem factor 7``. ``{w3}`` is a beginning.
    """

    qualifiers: tuple[str, ...] = ("gene", "mrna", "locus", "protein", "human", "disorder", "nos", "sodium", "hydrochloride", "isolate", "sp nov", "population", "process", "cascade", "obsolete")
    short: tuple[tuple[str, str], ...] = (("", "morbus {w}"), ("pathway", "{w} axis"), ("pathway", "{w} pathway"), ("cell", "{w3}+ cell"), ("*cyte", "{w3}+ cell"), ("", "{w4} mechanism"))
    pair: tuple[tuple[str, str], ...] = (("pathway", "{w3}/{v3}"), ("pathway", "{w}-{v} pathway"))
    numbered: tuple[tuple[str, str], ...] = (("factor", "{w3}F-{n}"),)


def clean(text: str) -> str:
    """Case, compatibility characters, Greek letters and outer quotes and punctuation folded away."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = "".join(" " + GREEK[c] + " " if c in GREEK else c for c in text)
    return re.sub(r"\s+", " ", text.replace("_", " ")).strip(" \t\"'«»“”‘’„‹›`.,;:!?")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def key_of(parts: Iterable[str]) -> str:
    """A form without spacing and dots, as the tree holds it."""
    return "".join(parts).replace(".", "")


def numbers(key: str) -> list[str]:
    return re.findall(r"\d+", key)


def variants(text: str, qualifiers: tuple[str, ...]) -> list[str]:
    """The cleaned text, and what is left when qualifiers, doses, articles and inversions are undone, mildest first.

    All combinations: every step shortens the text or takes a comma away, of which at most three are.
    """
    out, known = [text], {text}
    for t in out:  # grows while it is read
        tail = next((q for q in qualifiers if re.search(rf"(?:^|[\s,(\[]){re.escape(q).replace(chr(92) + ' ', r'[.]?[ ]')}[)\].]*$", t)), None)
        more = [
            t[4:] if t.startswith("the ") else t,
            BRACKET.sub("", t),
            re.sub(rf"[\s,(\[]+{re.escape(tail).replace(chr(92) + ' ', r'[.]?[ ]')}[)\].]*$", "", t) if tail else t,
            DOSE.sub("", t),
            " ".join(reversed(re.split(r",\s*", t, maxsplit=1))) if 0 < t.count(",") <= 3 else t,
            t[:-1] if t.endswith("s") and len(t) > 4 else t,
        ]
        for m in more:
            v = m.strip(" .,;:")
            if v and v not in known:
                known.add(v)
                out.append(v)
    return out


def words_of(name: str) -> list[str]:
    return [t for t in tokens(clean(name)) if len(t) > 2 and t.isalpha()]


def edits(key: str, written: str) -> int:
    """How many edits a form or value allows: none for symbols, codes and short words, two for long ones."""
    run = max(map(len, re.findall(r"[^\W\d_]+", key)), default=0)
    if len(key) >= WORD and run >= WORD - 1:
        return 2 if len(key) >= LONG else 1
    return int(SHORT <= len(key) == run and sum(c.isupper() for c in written) < 2)


def _filled(pattern: str, w: str, v: str = "", n: str = "") -> str:
    return pattern.format(w=w, v=v, n=n, w3=w[:3], w4=w[:4], v3=v[:3])


def derived(name: str, common: set[str], rules: Conventions) -> Iterator[str]:
    """Customary short forms of a name: of binomials, and of names built of rare words and common ones."""
    parts = tokens(clean(name))
    place = re.fullmatch(r"(\S+) (.+) of (?:the )?(\S+)", clean(name))
    if place:
        yield f"{place[1]} {place[3]} {place[2]}"
    rare = [t for t in parts if t.isalpha() and len(t) > 2 and t not in common]
    if len(parts) == 2 and len(rare) == 2 and name[:1].isupper():
        yield f"{parts[0][0]}. {parts[1]}"

    def fits(where: str) -> bool:
        return rare[0].endswith(where[1:]) if where[:1] == "*" else (len(parts) > 1 and where in ("", parts[-1]))

    if len(rare) == 1:
        yield from (_filled(pattern, rare[0]) for where, pattern in rules.short if fits(where))
    if len(rare) == 2:
        yield from (_filled(pattern, *rare) for where, pattern in rules.pair if where == parts[-1])
    if len(parts) > 2 and parts[-1] in common and parts[-2] in common:
        yield " ".join(parts[:-1])


FORM = "label string, key string, rank int, name string, edits int, initial string"
NUMBERED = re.compile(r"([A-Za-z]+)(\d+)$")


def _rows(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def common_words(listed: DataFrame) -> dict[str, set[str]]:
    """Per label the words of at least COMMON entries and of at least a hundredth of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(label, w) for label, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in sorted(set(words_of(name)))]
            yield _rows(pairs, ["label", "word"], [pa.string(), pa.string()])

    n = listed.groupBy("label").agg(F.count(F.lit(1)).alias("entries"))
    counts = listed.select("label", "name").mapInArrow(run, "label string, word string").groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, set[str]] = defaultdict(set)
    for r in counts.join(F.broadcast(n), "label").where(F.col("n") >= F.greatest(F.lit(COMMON), F.floor(F.col("entries") / 100))).collect():
        out[r["label"]].add(r["word"])  # some hundreds a label
    return dict(out)


def forms_of(entries: DataFrame, synonyms: DataFrame, rules: Conventions) -> tuple[DataFrame, dict[str, set[str]]]:
    """``(label, key, rank, name, edits, initial)``: one row per form of a label, and the common words.

    What is derived is judged over the whole list: a short form that two entries would have is none, and what one
    member's alias says of the stem of a numbered family holds for all its members if no other family has that stem.
    """
    by_name = synonyms.where("alias <> '' AND canonical IS NOT NULL").groupBy(F.col("canonical").alias("name")).agg(F.collect_set("alias").alias("__more"))
    none = F.array().cast("array<string>")
    each = entries.where("label IS NOT NULL AND name <> ''").select("label", "name", F.explode_outer("aliases").alias("alias"))
    listed = each.groupBy("label", "name").agg(F.collect_set("alias").alias("aliases"))
    listed = staged(listed.join(by_name, "name", "left").select("label", "name", F.array_union("aliases", F.coalesce("__more", none)).alias("aliases")), "listed")
    common = common_words(listed)
    shared = listed.sparkSession.sparkContext.broadcast(common)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["label", "key", "rank", "name", "edits", "initial", "family", "number", "stem"]

    def form(label: str, text: str, rank: int, name: str, initial: str | None = None) -> tuple:
        key = key_of(tokens(clean(text)))
        return (label, key, rank, name, edits(key, text), initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, name, aliases in zip(*(c.to_pylist() for c in batch.columns)):
                found.append((*form(label, name, NAME, name), None, None, None))
                found += [(*form(label, a, LISTED, name), None, None, None) for a in aliases if a]
                for text in derived(name, shared.value.get(label, set()), rules):
                    initial = text[0] if re.match(r"[a-z]\. ", text) else None
                    found.append((*form(label, text, DERIVED, name, initial), None, None, None))
                m = NUMBERED.match(name)
                if m:
                    found.append((label, None, None, name, None, None, m[1], m[2], None))
                    for a in aliases:
                        stem = a[: -len(m[2])] if a and a.endswith(m[2]) else ""
                        if len(stem) > 2 and not stem[-1].isdigit():
                            found.append((label, key_of(tokens(clean(stem))), None, None, None, None, m[1], None, stem))
            yield _rows(found, names, kinds)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, name, number, stem in zip(*(c.to_pylist() for c in batch.columns)):
                texts = [stem + number]
                for where, pattern in rules.numbered:
                    word = re.match(rf"([a-z]{{5,}}) {re.escape(where)} ?$", stem)
                    texts += [_filled(pattern, word[1], n=number)] if word else []
                found += [form(label, text, DERIVED, name) for text in texts]
            yield _rows(found, names[:6], kinds[:6])

    made = staged(listed.select("label", "name", "aliases").mapInArrow(run, ", ".join(f"{n} {'int' if k == pa.int32() else 'string'}" for n, k in zip(names, kinds))), "made")
    own = made.where("rank IS NOT NULL AND key <> ''").select(*names[:6])
    one = own.where(F.col("rank") == DERIVED).groupBy("label", "key").agg(F.min("name").alias("name"), F.max("name").alias("__other"), F.max("edits").alias("edits"), F.min("initial").alias("initial"))
    one = one.where("name = __other").select("label", "key", F.lit(DERIVED).alias("rank"), "name", "edits", "initial")
    stems = made.where("stem IS NOT NULL").groupBy("label", "key").agg(F.min("family").alias("family"), F.max("family").alias("__other"), F.collect_set("stem").alias("stems")).where("family = __other")
    stems = stems.select("label", "family", F.explode("stems").alias("stem"))
    numbered = made.where("number IS NOT NULL").select("label", "family", "name", "number").join(stems, ["label", "family"]).select("label", "name", "number", "stem")
    every = own.where(F.col("rank") < DERIVED).unionByName(one).unionByName(numbered.mapInArrow(members, FORM).where("key <> ''"))
    best = every.groupBy("label", "key").agg(F.min(F.struct("rank", "name")).alias("b"), F.max("edits").alias("edits"), F.min(F.when(F.col("rank") == DERIVED, F.col("initial"))).alias("initial"))
    return staged(best.select("label", "key", "b.rank", "b.name", "edits", "initial"), "forms"), common


class Forms:
    """Forms of one label in a tree, ``(key, rank, name, edits, initial)``, and the label's common words."""

    def __init__(self, rows: Iterable[tuple[str, int, str, int, str | None]], common: set[str], rules: Conventions):
        self.of = {key: (rank, name, allowed, initial) for key, rank, name, allowed, initial in rows}
        self.tree, self.common, self.rules = BKTree(sorted(self.of)), common, rules
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for w in sorted(common):
            self.by_first[w[0]].append(w)
        self.spelt: dict[str, str | None] = {}

    def _common_word(self, token: str) -> str | None:
        """The common word that a token abbreviates or misspells."""
        if token not in self.spelt:
            if len(self.spelt) >= MOST_REMEMBERED:
                self.spelt.clear()
            self.spelt[token] = self._meant(token)
        return self.spelt[token]

    def _meant(self, token: str) -> str | None:
        bare = token.rstrip(".")
        if bare in self.common or not bare.isalpha():
            return None
        alike = self.by_first.get(bare[0], ())
        if len(bare) > (2 if token.endswith(".") else 3):  # the last dot of a value may be gone
            longer = [w for w in alike if w.startswith(bare)]
            if len(longer) == 1:
                return longer[0]
        if token.endswith(".") and len(bare) > 3:
            spelt = [w for w in alike if len(w) > len(bare) and Pattern(bare).distance(w) <= 2]
            if len(spelt) == 1:
                return spelt[0]
        if len(bare) > 4:
            near = [w for w in sorted(self.common) if abs(len(w) - len(bare)) < 2 and len(w) > 4 and one_edit(bare, w)]
            if len(near) == 1:
                return near[0]
        return None

    def readings(self, text: str) -> Iterator[list[str]]:
        """The tokens of a variant as they stand, with Roman numerals read, and with common words put right."""
        parts = tokens(text)
        yield parts
        roman = [ROMAN[t] if i and t in ROMAN else t for i, t in enumerate(parts)]
        if roman != parts:
            yield roman
        put = [self._common_word(t) or t for t in roman]
        if put != roman:
            yield put

    def search(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """``(place, kind, distance, rank, name)`` of hits that may win, places in order of preference.

        Exact hits have the places before all others. ``kind`` is 2 for entries two edits away, which count only if all
        of one place are of one entry. The search ends at the first place that decides, whatever other shards hold.
        """
        keys = list(dict.fromkeys(key for v in variants(clean(text), self.rules.qualifiers) for key in map(key_of, self.readings(v)) if key))
        for place, key in enumerate(keys):
            for _, form in self.tree.within(key, 0):
                rank, name, _, _ = self.of[form]
                return [(place - len(keys), 0, 0, rank, name)]
        out: list[tuple[int, int, int, int, str]] = []
        for place, key in enumerate(keys):
            allowed = edits(key, text)
            if not allowed:
                continue
            near, far = [], {}
            for distance, form in self.tree.within(key, 2):
                rank, name, most, initial = self.of[form]
                if not most or numbers(form) != numbers(key) or (initial and form[0] != key[0]):
                    continue
                if one_edit(key, form):
                    if min(len(key), len(form)) >= WORD or key[0] == form[0]:
                        near.append((place, 1, distance, rank, name))
                elif min(allowed, most) > 1 and key[0] == form[0]:
                    far[name] = min(far.get(name, (3,)), (place, 2, distance, rank, name))
            if near:
                return [*out, min(near)]
            out += sorted(far.values())[:2]
        return out


def winner(hits: Iterable[tuple[int, int, int, int, str]]) -> str:
    """The name of the best hit, or '': doubtful places, two edits from several entries, decide nothing."""
    places: dict[tuple[int, int], list] = defaultdict(list)
    for h in hits:
        places[h[0], h[1]].append(h)
    for place, kind in sorted(places):
        found = places[place, kind]
        if kind < 2 or len({h[4] for h in found}) == 1:
            return min(found)[4]
    return ""


class Resolver:
    """Values to names, within their labels, from rows of :func:`forms_of`."""

    def __init__(self, forms: Iterable[tuple], common: dict[str, set[str]], rules: Conventions):
        labels: dict[str, list[tuple]] = defaultdict(list)
        for label, *row in forms:
            labels[label].append(tuple(row))
        self.labels = {label: Forms(rows, common.get(label, set()), rules) for label, rows in labels.items()}
        self.known: dict[tuple[str, str], str] = {}

    def hits(self, label: str, text: str) -> list[tuple[int, int, int, int, str]]:
        forms = self.labels.get(label)
        return forms.search(text) if forms else []

    def __call__(self, label: str, text: str) -> str:
        if (label, text) not in self.known:
            if len(self.known) >= MOST_REMEMBERED:
                self.known.clear()
            self.known[label, text] = winner(self.hits(label, text))
        return self.known[label, text]


_made: dict[str, Resolver] = {}


def resolver_for(token: str, forms: list[tuple], common: dict[str, set[str]], rules: Conventions) -> Resolver:
    """The resolver of this process for one list of forms, with the values it has seen; made by the first task."""
    if token not in _made:
        _made.clear()
        _made[token] = Resolver(forms, common, rules)
    return _made[token]


def unlisted(df: DataFrame, entries: DataFrame, label: str = "label", name: str = "canonical_name") -> DataFrame:
    """The rows whose name is null or isn't exactly that of an entry of their label."""
    listed = entries.select(F.col("label").alias("__l"), F.col("name").alias("__n")).where("__l IS NOT NULL AND __n IS NOT NULL").distinct()
    if listed.count() <= MOST_FORMS:
        listed = F.broadcast(listed)
    return df.join(listed, (F.col(label) == F.col("__l")) & (F.col(name) == F.col("__n")), "left_anti")


def map_values(
    df: DataFrame, entries: DataFrame, synonyms: DataFrame, key: str = "span_id", label: str = "label", text: str = "text", most_forms: int | None = None, rules: Conventions = Conventions()
) -> DataFrame:
    """``(key, name)``: for each row with text and label the name of the entry of that label it stands for, or ``''``.

    A key that comes several times counts once; rows with a null key, text or label are left out; empty and blank texts
    and texts of an unknown label stand for nothing; of equally near entries the first by rank of form (name, listed
    alias, derived form) and then by name is taken; other columns don't matter; with no entries every name is ``''``.
    The forms are worked out by jobs that run at once.
    """
    most_forms = MOST_FORMS if most_forms is None else most_forms
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key), F.col(label).alias("__label"), F.col(text).alias("__text"))
    forms, common = forms_of(entries, synonyms, rules)
    size = forms.count()
    if size <= most_forms:
        return _mapped_by_one(rows, forms, common, rules, key).dropDuplicates([key])
    return _mapped_by_shards(rows, forms, common, rules, key, -(-size // max(1, most_forms))).dropDuplicates([key])


def _mapped_by_one(rows: DataFrame, forms: DataFrame, common: dict[str, set[str]], rules: Conventions, key: str) -> DataFrame:
    listed = [tuple(r) for r in forms.select("label", "key", "rank", "name", "edits", "initial").collect()]  # at most MOST_FORMS
    shared = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, listed, common, rules))
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("name", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = resolver_for(*shared.value)
        for batch in batches:
            found = [resolver(l, t) for l, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _mapped_by_shards(rows: DataFrame, forms: DataFrame, common: dict[str, set[str]], rules: Conventions, key: str, shards: int) -> DataFrame:
    """The forms in shards by hash: each distinct value meets every shard, and the shards' winners are merged."""
    shared = rows.sparkSession.sparkContext.broadcast((common, rules))
    values = rows.select("__label", "__text").distinct()
    blocks = max(1, -(-values.count() // 50_000))
    asked = values.withColumn("block", F.pmod(F.xxhash64("__text"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = forms.withColumn("shard", F.pmod(F.xxhash64("label", "key"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["__label", "__text", "place", "kind", "distance", "rank", "name"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        resolver = Resolver(zip(*(right[c].to_pylist() for c in ("label", "key", "rank", "name", "edits", "initial"))), *shared.value)
        found = [(l, t, *h) for l, t in zip(left["__label"].to_pylist(), left["__text"].to_pylist()) for h in resolver.hits(l, t)]
        return pa.Table.from_batches([_rows(found, names, kinds)])

    hits = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, ", ".join(f"{n} {'int' if k == pa.int32() else 'string'}" for n, k in zip(names, kinds)))
    places = hits.groupBy("__label", "__text", "place", "kind").agg(F.min(F.struct("distance", "rank", "name")).alias("best"), F.min("name").alias("__a"), F.max("name").alias("__b"))
    sure = places.where("kind < 2 OR __a = __b")
    best = sure.groupBy("__label", "__text").agg(F.min(F.struct("place", "kind", "best")).alias("w")).select("__label", "__text", F.col("w.best.name").alias("name"))
    return rows.join(best, ["__label", "__text"], "left").select(key, F.coalesce("name", F.lit("")).alias("name"))
