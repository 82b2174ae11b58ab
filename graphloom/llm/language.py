"""Problem 9: the language of every document and of every stretch in another language, whatever its label says.

Method: multinomial naive Bayes over hashed character n-grams. Texts are cut into sentences; all n-grams of a batch are
hashed at once in numpy, and the scores of its sentences are segment sums over the columns of one broadcast matrix of
log probabilities. Neighbouring sentences of one language make a segment.

The model is fitted on a bounded sample of labelled rows (``per_language`` documents of each label, the first
``sample_chars`` characters of each, chosen by a hash of the key): sentences start with the label of their document,
and a few rounds of refitting move those that were labelled wrongly or stand in mixed documents. The sample is the
only part with a bound; every sentence of every document is scored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# fixed values: two-letter code, three-letter codes (terminological, bibliographic) and English name of languages that a
# label may name; those that a model knows come from the labels of its table
LANGUAGES = {
    "ar": ("ara", "ara", "arabic"),
    "bg": ("bul", "bul", "bulgarian"),
    "ca": ("cat", "cat", "catalan"),
    "cs": ("ces", "cze", "czech"),
    "da": ("dan", "dan", "danish"),
    "de": ("deu", "ger", "german"),
    "el": ("ell", "gre", "greek"),
    "en": ("eng", "eng", "english"),
    "es": ("spa", "spa", "spanish"),
    "et": ("est", "est", "estonian"),
    "fa": ("fas", "per", "persian"),
    "fi": ("fin", "fin", "finnish"),
    "fr": ("fra", "fre", "french"),
    "he": ("heb", "heb", "hebrew"),
    "hi": ("hin", "hin", "hindi"),
    "hr": ("hrv", "hrv", "croatian"),
    "hu": ("hun", "hun", "hungarian"),
    "id": ("ind", "ind", "indonesian"),
    "it": ("ita", "ita", "italian"),
    "ja": ("jpn", "jpn", "japanese"),
    "ko": ("kor", "kor", "korean"),
    "lt": ("lit", "lit", "lithuanian"),
    "lv": ("lav", "lav", "latvian"),
    "nl": ("nld", "dut", "dutch"),
    "no": ("nor", "nor", "norwegian"),
    "pl": ("pol", "pol", "polish"),
    "pt": ("por", "por", "portuguese"),
    "ro": ("ron", "rum", "romanian"),
    "ru": ("rus", "rus", "russian"),
    "sk": ("slk", "slo", "slovak"),
    "sl": ("slv", "slv", "slovenian"),
    "sv": ("swe", "swe", "swedish"),
    "th": ("tha", "tha", "thai"),
    "tr": ("tur", "tur", "turkish"),
    "uk": ("ukr", "ukr", "ukrainian"),
    "vi": ("vie", "vie", "vietnamese"),
    "zh": ("zho", "chi", "chinese"),
}
#: A language is one of the model's when at least this share of the labelled documents of the sample bears its label.
LEAST_SHARE = 0.005
ORDERS, BITS, SMOOTHING = (2, 3), 16, 0.5
#: Share of the n-grams of all languages in each language's estimate: names occur in texts of every language.
SHARED = 0.5
#: Letters a sentence needs to be judged by itself; a Han character counts as HAN_WEIGHT letters.
LEAST_LETTERS, HAN_WEIGHT = 16, 4
#: Longest mean word, in letters, of a text with spaces; more is no language (sequences, encodings).
LONGEST_WORD = 25
#: How far a sentence may lie below its language's usual likelihood a letter, in differences times the root of the letters
#: as they are for sentences of the language that the model wasn't fitted on: BEYOND times as far below their median as
#: all but a share ODD of them are. (Quantiles, as some texts that bear a language's label are in none.)
BEYOND, ODD, LEAST_KNOWN, COMMON_LIMIT = 2.3, 0.05, 100, -15.0
#: Neighbouring n-grams share their letters; so many of them hold a letter, and evidence counts as much less.
OVERLAP = float(sum(ORDERS))
#: Nats a stretch must be likelier in its language than in that of the text around it to be taken for another one.
SWITCH = 12.0
#: Nats a letter by which a sentence of the sample must be likelier in another language to lose its document's label.
RELABEL = 0.25
#: Weights are kept in steps of 1 / STEPS nats from LOWEST up, three languages of 21 bits in an integer; no more than
#: STRETCH of them are added in one sum.
STEPS, LOWEST, STRETCH = 16, -8.0, 4096
#: Texts scored together, in characters.
TOGETHER = 250_000

SENTENCE_END = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』»]*|\n+")


def declared_codes(label: Column) -> Column:
    """The two-letter codes that a free-form label names: ``EN``, `` en-GB``, ``eng``, ``English`` and lists of these."""
    known = {name: code for code, names in LANGUAGES.items() for name in (code, *names)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    words = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}]+")
    first = F.filter(F.transform(words, lambda w: F.element_at(table, w)), lambda c: c.isNotNull())
    # after a primary code, what follows a hyphen is a region or script
    parts = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[\s,;/|+&]+")
    tags = F.transform(parts, lambda p: F.element_at(table, F.regexp_extract(p, r"\p{L}+", 0)))
    return F.array_distinct(F.coalesce(F.filter(tags, lambda c: c.isNotNull()), first))


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, whole)`` of the sentences and lines of the text; whole: it ends with a sentence's end."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        start = m.start()
        if text[start] == ".":  # not after an initial
            before = text[max(0, start - 2) : start]
            if before[-1:].isupper() and not before[:-1].isalnum():
                continue
        line = text[start] == "\n"
        end = start if line else m.end()
        if text[at:end].strip():
            out.append((at, end, not line))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text), text.rstrip()[-1:] in tuple(".!?。！？»")))
    return out


_alphabet: list[np.ndarray] = []


def alphabet() -> np.ndarray:
    """0 for code points that aren't letters, else HAN_WEIGHT or 1."""
    if not _alphabet:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        table[[c for c in range(0x40000) if chr(c).isalpha()]] = 1
        table[0x3400:0xA000] *= HAN_WEIGHT
        _alphabet.append(table)
    return _alphabet[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashes of the n-grams that start at each place; other characters than letters are one."""
    letters = np.where(alphabet()[codes] > 0, codes, 32).astype(np.uint64)
    padded = np.concatenate([letters, np.full(max(ORDERS), 32, np.uint64)])
    out, h, n = [], np.zeros(len(letters), np.uint64), len(letters)
    for k in range(max(ORDERS)):
        h = (h + padded[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return out


@dataclass
class Model:
    codes: list[str]
    packed: np.ndarray  # order, group of three languages, hash: the weights of three languages side by side
    usual: np.ndarray | None = None  # mean nats a letter of each language's own sentences
    limit: np.ndarray | None = None  # the least that a sentence may differ from it, times the root of its letters

    @staticmethod
    def of(codes: list[str], weights: np.ndarray) -> Model:
        """From log probabilities, less those of a uniform hash, by order, language and hash."""
        q = np.clip(np.rint((weights - LOWEST) * STEPS), 0, 255).astype(np.int64)
        groups = [sum(q[:, i + k] << (21 * k) for k in range(3) if i + k < len(codes)) for i in range(0, len(codes), 3)]
        return Model(codes, np.stack(groups, axis=1))

    def spoken(self, score: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Whether the sentences of a text are long enough to be judged and as likely as sentences of their likeliest language are.

        Where half of the text is in no known language, the rest must be within half of the limit.
        """
        best = score.argmax(axis=1)
        n = np.maximum(letters, 1)
        long, off = letters >= LEAST_LETTERS, (score.max(axis=1) / n - self.usual[best]) * np.sqrt(n)
        fit = long & (off >= self.limit[best])
        if fit.any() and 2 * letters[fit].sum() <= letters[long].sum():
            fit &= off >= self.limit[best] / 2
        return fit

    def score(self, text: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores in nats (stretches x languages) and weighed letters of the stretches between neighbouring ``cuts``.

        Stretches whose words are too long for a language with spaces have no letters.
        """
        codes = _codes(_lower(text))
        weight = alphabet()[codes]
        place = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])[cuts]  # where each begins among the letters
        letters = np.diff(place)
        begins = np.concatenate([[0], np.cumsum((weight > 0) & (np.concatenate([[0], weight[:-1]]) == 0))])[cuts]
        han = np.diff(np.concatenate([[0], np.cumsum(weight > 1)])[cuts])
        spoken = (letters <= LONGEST_WORD * np.diff(begins)) | (2 * HAN_WEIGHT * han >= letters)
        starts = np.unique(np.concatenate([place[:-1], np.arange(0, max(1, place[-1]), STRETCH)]))
        starts = starts[starts < place[-1]]
        out = np.zeros((len(letters), len(self.codes)))
        if not len(starts):
            return out, letters * spoken
        owner = np.searchsorted(place, starts, side="right") - 1
        for order, h in enumerate(grams(codes)):
            h = np.repeat(h, weight)
            for group in range(self.packed.shape[1]):
                sums = np.add.reduceat(self.packed[order, group].take(h), starts)
                for k in range(3):
                    if 3 * group + k < len(self.codes):
                        out[:, 3 * group + k] += np.bincount(owner, (sums >> (21 * k)) & ((1 << 21) - 1), minlength=len(letters))
        return out / STEPS + LOWEST * len(ORDERS) * letters[:, None], letters * spoken


def _weights(hashes: list[np.ndarray], label: np.ndarray, languages: int) -> np.ndarray:
    """Log probabilities of the n-grams ``hashes`` whose languages are ``label``, less those of a uniform hash."""
    out = np.zeros((len(ORDERS), languages, 1 << BITS))
    for order, h in enumerate(hashes):
        n = np.bincount(label * (1 << BITS) + h, minlength=languages << BITS).reshape(languages, -1) + SMOOTHING
        p = n / n.sum(axis=1, keepdims=True)
        out[order] = np.log((1 - SHARED) * p + SHARED * p.mean(axis=0)) + np.log(1 << BITS)
    return out


def fit(texts: list[str], labels: list[str], rounds: int = 3) -> Model | None:
    """A model of the languages in ``labels`` from labelled texts, some of them labelled wrongly; None without any.

    What a sentence of a language may look like is learnt from sentences that a model of the other half of the texts
    scores; likelier ones than those are taken, others are in none of the model's languages.
    """
    codes = sorted(set(labels))
    if not codes:
        return None
    parts = [(t[a:b], codes.index(l), i % 2) for i, (t, l) in enumerate(zip(texts, labels)) for a, b, _ in sentences(t)]
    label, half = np.array([l for _, l, _ in parts], np.int64), np.array([h for _, _, h in parts], np.int64)
    joined = "\n".join(p for p, _, _ in parts)
    cuts = np.concatenate([[0], np.cumsum([len(p) + 1 for p, _, _ in parts], dtype=np.int64)])
    cuts[-1] = max(0, cuts[-1] - 1)
    points = _codes(_lower(joined))
    weight = alphabet()[points]
    owner = np.repeat(np.repeat(np.arange(len(parts)), np.diff(cuts)), weight)
    hashes = [np.repeat(h, weight) for h in grams(points)]
    model = Model.of(codes, _weights(hashes, label[owner], len(codes)))
    usual, limit = np.zeros(len(codes)), np.full(len(codes), COMMON_LIMIT)
    if not parts:
        return Model(codes, model.packed, usual, limit)
    for _ in range(rounds - 1):
        score, letters = model.score(joined, cuts)
        gain = score.max(axis=1) - score[np.arange(len(label)), label]
        label = np.where((gain > RELABEL * letters) & (letters >= LEAST_LETTERS), score.argmax(axis=1), label)
        model = Model.of(codes, _weights(hashes, label[owner], len(codes)))
    own = np.zeros(len(parts))
    for side in (0, 1):
        inside = half[owner] == side
        other, letters = Model.of(codes, _weights([h[inside] for h in hashes], label[owner][inside], len(codes))).score(joined, cuts)
        own = np.where(half == side, own, other[np.arange(len(label)), label])
    for c in range(len(codes)):
        known = (label == c) & (letters >= LEAST_LETTERS)
        if known.any():
            usual[c] = np.median(own[known] / letters[known])
        if known.sum() >= LEAST_KNOWN:
            low, middle = np.quantile((own[known] / letters[known] - usual[c]) * np.sqrt(letters[known]), [ODD, 0.5])
            limit[c] = middle - BEYOND * (middle - low)
    return Model(codes, model.packed, usual, limit)


def sample_and_fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 250, sample_chars: int = 4000) -> Model | None:
    """The model of the languages that a table's labels name: at most ``per_language`` documents of each label, of each at most ``sample_chars`` characters."""
    codes = declared_codes(F.col(label))
    light = df.where(F.length(text) > 0).select(F.col(key).alias("__key"), F.element_at(F.when(F.size(codes) == 1, codes), 1).alias("__code")).where("__code IS NOT NULL")
    first = Window.partitionBy("__code").orderBy(F.xxhash64("__key"), "__key")
    chosen = light.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_language).drop("__n")
    rows = (
        df.select(F.col(key).alias("__key"), F.substring(text, 1, sample_chars).alias("__text"))
        .join(F.broadcast(chosen), "__key")  # at most per_language rows a language
        .select("__text", "__code")
        .collect()
    )
    counts = Counter(r["__code"] for r in rows)
    rows = [r for r in rows if counts[r["__code"]] >= LEAST_SHARE * len(rows)]
    return fit([r["__text"] for r in rows], [r["__code"] for r in rows])


SEGMENT = StructType(
    [
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("lang_code", StringType()),
        StructField("confidence", DoubleType()),
        StructField("whole_sentences", IntegerType()),
    ]
)


Judged = tuple[str | None, float | None, list[tuple[int, int, str, float, int]]]


def _path(score: np.ndarray) -> np.ndarray:
    """The languages of consecutive sentences with the highest total score.

    Each stretch in another language than the likeliest one of the whole text costs SWITCH, wherever it stands; the way
    back costs nothing.
    """
    languages = np.arange(score.shape[1])
    toll = np.where(languages == score.sum(axis=0).argmax(), 0.0, SWITCH)
    back, total = [], score[0] - toll
    for row in score[1:]:
        best = int(total.argmax())
        change = total < total[best] - toll
        back.append(np.where(change, best, languages))
        total = np.where(change, total[best] - toll, total) + row
    out = [int(total.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return np.array(out[::-1])


def _segments(model: Model, parts: list[tuple[int, int, bool]], score: np.ndarray, letters: np.ndarray) -> Judged:
    sure, codes = model.spoken(score, letters), model.codes
    if not sure.any():
        return None, None, []
    best = score.argmax(axis=1)
    if (best[sure] != best[sure][0]).any():
        best = _path(np.where(sure[:, None], score, 0.0))
    else:
        best[:] = best[sure][0]
    posterior = 1 / np.exp(np.minimum((score - score[np.arange(len(best)), best][:, None]) / OVERLAP, 30)).sum(axis=1)
    weight: dict[int, float] = {}
    segments: list[list] = []
    for (start, end, whole), language, n, p, known in zip(parts, best.tolist(), letters.tolist(), posterior.tolist(), sure.tolist()):
        if not (segments and segments[-1][2] == language):
            segments.append([start, end, language, 0.0, 0, 0])
        last = segments[-1]
        last[1] = end
        if known:
            weight[language] = weight.get(language, 0.0) + n * p
            last[3] += n * p
            last[4] += n
            last[5] += whole
    out = [(a, b, codes[c], s / n, w) for a, b, c, s, n, w in segments if n]
    main = max(weight, key=lambda c: (weight[c], -c))
    return codes[main], weight[main] / int(letters[sure].sum()), out


def judge_all(model: Model | None, texts: list[str | None]) -> list[Judged]:
    """Language and confidence of each text, and its segments; no language where nothing can be judged."""
    out: list[Judged] = [(None, None, [])] * len(texts)
    held: list[tuple[int, list]] = []
    size = 0
    for i, text in enumerate(texts):
        parts = sentences(text) if text and model else []
        if parts:
            held.append((i, parts))
            size += len(text)
        if held and (size >= TOGETHER or i == len(texts) - 1):
            cuts, at = [0], 0
            for k, own in held:  # what lies between two sentences has no letters, or belongs to the one before
                cuts += [at + b for _, b, _ in own]
                at += len(texts[k]) + 1
            score, letters = model.score("\n".join(texts[k] for k, _ in held), np.array(cuts))
            at = 0
            for k, own in held:
                out[k] = _segments(model, own, score[at : at + len(own)], letters[at : at + len(own)])
                at += len(own)
            held, size = [], 0
    return out


def label_languages(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``(key, declared ARRAY<STRING>, lang_code, confidence, segments)``, one row per input row.

    ``segments`` are stretches of one language in order, with offsets in code points, a confidence in (0, 1] and the
    number of whole sentences; ``lang_code`` is the language of most letters. Null, empty, blank texts and texts of no
    language that the model knows have a null ``lang_code`` and ``confidence`` and no segments; without a model all have. Equal scores go to the first code in the
    alphabet. A null key or label is allowed; repeated rows are judged each; other columns don't matter.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model and (model.codes, model.packed, model.usual, model.limit))  # orders x languages x 2^BITS
    schema = StructType(
        [
            StructField(key, df.schema[key].dataType),
            StructField("declared", ArrayType(StringType())),
            StructField("lang_code", StringType()),
            StructField("confidence", DoubleType()),
            StructField("segments", ArrayType(SEGMENT)),
        ]
    )
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64()), ("whole_sentences", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = shared.value and Model(*shared.value)
        names = ("start", "end", "lang_code", "confidence", "whole_sentences")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = judge_all(judged, part.column(2).to_pylist())
                segments = pa.array([[dict(zip(names, s)) for s in f[2]] for f in found], kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), segments],
                    names=schema.names,
                )

    return df.select(F.col(key), declared_codes(F.col(label)).alias("declared"), F.col(text).alias("__text")).mapInArrow(run, schema)


def undeclared(labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, lang_code)``: languages of at least one whole sentence that the label doesn't name."""
    spoken = F.array_distinct(F.transform(F.filter("segments", lambda s: s["whole_sentences"] > 0), lambda s: s["lang_code"]))
    return labelled.select(key, F.explode(F.array_except(spoken, F.coalesce("declared", F.array().cast("array<string>")))).alias("lang_code"))
