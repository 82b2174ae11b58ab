"""The training-data operators against brute force, exact round trips, and the odd cases each must stand."""

import inspect
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bktree, canonical, catalog, knn, language, mixing, near_duplicates, scanned, split, tokenize
from graphloom.llm.hnsw import Graph


def clashing(df):
    """The table with further columns named like the operators' own."""
    return df.withColumns({c: F.lit("x") for c in ("n", "same", "vh", "ids", "name ", "block", "shard", "range", "piece_index", "defects", "h", "word") if c not in df.columns})


# -- 1 -----------------------------------------------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(old, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_distance_is_levenshtein(a, b):
    assert bktree.Pattern(a).distance(b) == levenshtein(a, b)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=7), max_size=40), st.text("ab", max_size=7), st.integers(0, 3))
def test_tree_returns_every_entry_within(entries, query, t):
    assert bktree.BKTree(entries).within(query, t) == sorted({(levenshtein(query, e), e) for e in entries if levenshtein(query, e) <= t})


def test_small_edits_by_length():
    rules = canonical.Conventions()
    names = ["hypertension", "acetaminophen", "Parkinson disease", "aspirin", "patinsixdorel", "patinsiydorel", "TP53", "KRAS"]
    rows = [("D", canonical.key_of(canonical.tokens(canonical.clean(n))), 0, n, canonical.edits(canonical.key_of(canonical.tokens(canonical.clean(n))), n), None) for n in names]
    find = canonical.Resolver(rows, {"D": {"disease"}}, rules)
    values = {"hypertenssionn": "hypertension", "acetaminofen": "acetaminophen", "Parkinsson diseese": "Parkinson disease", "aspirn": "aspirin", "patinsixdorl": "patinsixdorel", "patinsidorell": "", "TP54": "", "KRAZ": "", "pypertenssion": ""}
    assert {v: find("D", v) for v in values} == values


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abcd ", min_size=6, max_size=14), min_size=1, max_size=25, unique=True), st.lists(st.text("abcd ", min_size=5, max_size=15), max_size=15), st.integers(2, 5))
def test_shards_agree_with_one_tree(names, values, shards):
    rules = canonical.Conventions()
    rows = {}
    for n in sorted(names):
        key = canonical.key_of(canonical.tokens(canonical.clean(n)))
        rows.setdefault(key, ("D", key, 0, n, canonical.edits(key, n), None))
    rows.pop("", None)
    rows = list(rows.values())
    whole = canonical.Resolver(rows, {}, rules)
    parts = [canonical.Resolver([r for i, r in enumerate(rows) if i % shards == k], {}, rules) for k in range(shards)]
    for v in [*values, *names, *(n[1:] for n in names)]:
        assert whole("D", v) == canonical.winner([h for p in parts for h in p.hits("D", v)])


ENTRIES = [
    ("Gene", "ABC7", ["stemone factor 7"]),
    ("Gene", "ABC8", []),
    ("Drug", "longdrugname", None),
    ("Organism", "Genusname speciesii", []),
    ("Disease", "juvenile Rarename syndrome", None),
    *[("Disease", f"juvenile {w}name syndrome", []) for w in ("Zubor", "Kilop", "Werot", "Quint")],
]
VALUES = [
    ("Gene", "abc 7", "ABC7"), ("Gene", "«ABC-7» gene", "ABC7"), ("Gene", "ABC9", ""), ("Gene", "ABD7", ""), ("Gene", "stemone factor 8", "ABC8"), ("Drug", "longdrgname", "longdrugname"),
    ("Drug", "longdrugname sodium", "longdrugname"), ("Drug", "", ""), ("Drug", "   ", ""), ("Planet", "ABC7", ""), ("Organism", "G. speciesii", "Genusname speciesii"), ("Organism", "H. speciesii", ""),
    ("Disease", "Rarename syndrome, juvenile", "juvenile Rarename syndrome"), ("Disease", "juv. Rarenaem synd.", "juvenile Rarename syndrome"), ("Disease", "x" * 5000, ""), ("Gene", "longdrugname", ""),
]


@pytest.mark.parametrize("most_forms", [1000, 3])
def test_values_to_names(spark, most_forms):
    rows = [(i, l, t) for i, (l, t, _) in enumerate(VALUES)] * 2 + [(None, "Gene", "ABC7"), (90, None, "ABC7"), (91, "Gene", None)]
    spans = clashing(spark.createDataFrame(rows, "span_id long, label string, text string"))
    entries = spark.createDataFrame(ENTRIES, "label string, name string, aliases array<string>")
    got = {r["span_id"]: r["name"] for r in canonical.map_values(spans, entries, spark.createDataFrame([("alia", "ABC8"), (None, "x")], "alias string, canonical string"), most_forms=most_forms).collect()}
    expected = {i: name for i, (_, _, name) in enumerate(VALUES)}
    if most_forms == 3:  # a word is common by the whole list, so shards agree
        assert {k: got[k] for k in got} == expected
    assert got == expected
    assert canonical.map_values(spans.limit(0), entries, spark.createDataFrame([], "alias string, canonical string")).count() == 0
    none = canonical.map_values(spans, entries.limit(0), spark.createDataFrame([], "alias string, canonical string"))
    assert {r["name"] for r in none.collect()} == {""}


# -- 2 -----------------------------------------------------------------------------------------------------------------


def test_graph_recall_and_storage():
    v = np.random.default_rng(1).normal(size=(1500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph.build(v, keep=5)
    ids, _ = Graph.from_bytes(g.to_bytes()).search(v, 6, 40)
    true = np.argsort(-(v @ v.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(g.near[0], true[:, 1:])]) >= 0.95
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, true)]) >= 0.95
    for n in (1, 2, 3):
        assert Graph.build(v[:n]).search(v[:n], 5, 8)[0].shape[0] == n


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 60)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    vectors = {f"k{i:04d}": (base[i % 30] + 0.3 * rng.normal(size=8)).tolist() for i in range(400)}
    rows = list(vectors.items()) + list(vectors.items())[:20]
    rows += [("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("inf", [float("inf")] + [1.0] * 7), ("hole", [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(f"same{i:02d}", [1.0] * 8) for i in range(12)]
    df = clashing(spark.createDataFrame(rows, "key string, embedding array<double>"))
    got = {}
    for r in knn.neighbours(df, dim=8).collect():
        got.setdefault(r["key"], []).append(r["neighbour"])
    assert not {"null", "short", "zero", "nan", "inf", "hole", None} & set(got)
    assert all(len(got[f"same{i:02d}"]) == 5 and all(x.startswith("same") for x in got[f"same{i:02d}"]) for i in range(12))
    assert sorted(got["same11"]) == [f"same{i:02d}" for i in range(5)]
    keys = sorted(vectors) + [f"same{i:02d}" for i in range(12)]
    m = np.array([vectors.get(k, [1.0] * 8) for k in keys])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    hits = [len({keys[j] for j in np.argsort(-s[i])[:5]} & set(got[k])) for i, k in enumerate(keys) if k in vectors]
    assert sum(hits) / (5 * len(hits)) >= 0.9
    assert knn.neighbours(df.limit(0), dim=8).count() == 0 == knn.neighbours(df.where("key = 'k0001'"), dim=8).count()


def test_index_serves_other_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 200)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(f"k{i:04d}", (base[i % 40] + 0.5 * rng.normal(size=16)).tolist()) for i in range(1500)]
    usable = knn.unit_vectors(spark.createDataFrame(rows, "key string, embedding array<double>"), "key", "embedding", 16).cache()
    plan = knn.plan_cells(usable, 1500, 16, 5)
    assert len(plan.centres) > 4 and plan.covered >= knn.COVER
    asked = usable.where("key LIKE '%00'").withColumn("key", F.concat(F.lit("q"), "key"))
    got = {(r["key"], r["neighbour"]) for r in knn.search_index(knn.build_index(usable, plan, 16), asked, plan, 16, 5).collect()}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = {(f"qk{i:04d}", f"k{j:04d}") for i in range(0, 1500, 100) for j in np.argsort(-(v @ v[i]))[:5]}
    assert len(got) == len(true) and len(got & true) / len(true) >= 0.9


def test_recall_on_test_vectors(spark, data):
    got = {(r["key"], r["neighbour"]) for r in catalog.queries()["p2_neighbours"](spark, data).collect()}
    v = {r["key"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{data}/vectors.parquet").collect() if r["embedding"] and len(r["embedding"]) == 64}
    v = {k: x / np.linalg.norm(x) for k, x in v.items() if np.isfinite(x).all() and x.any()}
    keys = sorted(v)
    s = np.stack([v[k] for k in keys]) @ np.stack([v[k] for k in keys]).T
    np.fill_diagonal(s, -2)
    true = {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-s[i])[:5]}
    assert len(true & got) / len(true) >= 0.9


# -- 3 -----------------------------------------------------------------------------------------------------------------


def word_runs(text, n=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for b in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(90)]
        for c in range(5):
            texts[f"d{b:02d}_{c}"] = edited(rng, words, c * 2)
    texts |= {f"copy{i:02d}": "the very same text in many copies Ä" for i in range(9)} | {"short": "two words", "shorter": "one", "empty": "", "blank": "  ", "low": "THE VERY—same text, in many copies ä!"}
    rows = list(texts.items()) * 2 + [("null", None), (None, "the very same text in many copies Ä")]
    df = clashing(spark.createDataFrame(rows, "chunk_id string, text string"))
    members, links = near_duplicates.near_duplicates(df)
    got = {tuple(r) for r in near_duplicates.pairs(members, links).collect()}
    runs = {k: s for k, t in texts.items() if (s := word_runs(t))}
    true = {(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) / len(runs[a] | runs[b]) >= 0.7}
    assert got == true
    groups = {r["chunk_id"]: r["group_id"] for r in near_duplicates.groups(members, links).collect()}
    assert set(groups) == set(runs) and all(groups[a] == groups[b] for a, b in true)
    assert len(set(groups.values())) == len(runs) - len(spanning(true))
    m, l = near_duplicates.near_duplicates(df.limit(0))
    assert m.count() == 0 == near_duplicates.pairs(m, l).count() == near_duplicates.groups(m, l).count()


def spanning(pairs):
    root, out = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(pairs):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


def test_crowded_bands_lose_nothing(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    rows = [(f"d{i:03d}", edited(rng, words, 2)) for i in range(40)]
    members, links = near_duplicates.near_duplicates(spark.createDataFrame(rows, "chunk_id string, text string"))
    sketches = near_duplicates.sketch(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text").select("same", "bands")
    few, many = near_duplicates.candidates(sketches, crowd=5)
    tight = {tuple(r) for r in few.union(many).collect()}
    assert {(r["a"], r["b"]) for r in links.collect()} <= {tuple(sorted(p)) for p in tight}



def test_crowded_family_at_the_threshold(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(240)]
    texts = {f"d{i:03d}": edited(rng, words, rng.choice((6, 7))) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    classes = near_duplicates.sketch(df, "chunk_id", "text").drop("chunk_id").distinct().cache()
    bands = {r["same"]: r["bands"] for r in classes.collect()}
    common = {(a, b): sum(x == y for x, y in zip(bands[a], bands[b])) for a in bands for b in bands if a < b}
    sharing = {p for p, n in common.items() if n}
    members, links = near_duplicates.near_duplicates(df)
    same = {r["chunk_id"]: r["same"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in links.collect()}
    runs = {k: word_runs(t) for k, t in texts.items()}
    near = {tuple(sorted((same[a], same[b]))) for a in runs for b in runs if a < b and 0.7 <= len(runs[a] & runs[b]) / len(runs[a] | runs[b]) <= 0.75}
    estimate = near_duplicates.estimated(F.col("x.sketch"), F.col("y.sketch"), 160)
    passing = {tuple(r) for r in classes.alias("x").join(classes.alias("y"), F.col("x.same") < F.col("y.same")).where(estimate >= 0.7 - 0.14).select("x.same", "y.same").collect()}
    assert any(common[p] == 1 for p in near & passing) and near & sharing & passing <= linked
    for crowd, block in ((5, 20), (1000, near_duplicates.BLOCK)):
        few, many = near_duplicates.candidates(classes, crowd=crowd, block=block)
        assert {tuple(r) for r in few.union(many).collect()} == sharing



def test_sketch_loses_one_pair_in_ten_thousand_at_the_threshold():
    rng = np.random.default_rng(1)
    slack = inspect.signature(near_duplicates.near_duplicates).parameters["slack"].default
    share = [1 - 2 * d / 512 for d in range(256)]
    lost, rounds, n = 0, 5, 20_000
    for _ in range(rounds):
        flips = 2 * rng.binomial(160, 0.3, n)  # samples that differ at 0.70, each with one bit of either text
        at = np.repeat(np.arange(n) * 512, flips) + rng.integers(0, 512, flips.sum())
        differing = (np.bincount(at, minlength=n * 512).reshape(n, 512) & 1).sum(axis=1)
        lost += sum(d > 255 or 1 + math.log(share[d]) * 0.8 < 0.7 - slack for d in differing.tolist())
    assert lost <= 2e-4 * rounds * n


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    roots = {r["id"]: r["root"] for r in near_duplicates.components(links).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# -- 5 -----------------------------------------------------------------------------------------------------------------


def test_abbreviations_end_no_sentence():
    assert [split.boundary_strength(w, " ") for w in ("al.", "(Fig.", "e.g.", "J.", "vs.", "cells.", "done.)", "x.", "2.")] == [0, 0, 0, 0, 0, 2, 2, 2, 2]
    assert split.boundary_strength("al.", "\n\n") == 3 and split.boundary_strength("al.", "\n") == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "c!\n\n", "d\n"]), max_size=900))
def test_pieces_cover_and_overlap(words):
    text = " ".join(words)
    pieces = split.bisect(text, limit=60, overlap=15)
    n = len(text.split())
    assert [p[2] for p in pieces[:1]] == [0][: len(pieces)] and (not n or pieces[-1][3] == n)
    assert all(b - a <= 60 for _, _, a, b in pieces) and all(p[3] - q[2] == 15 for p, q in zip(pieces, pieces[1:]))


def test_cuts_in_mid_sentence_only_where_no_end_would_do():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.choice((rng.randrange(1, 40), rng.randrange(40, 300), 700)) for _ in range(rng.randrange(1, 9))]
        ends = [sum(lengths[: i + 1]) for i in range(len(lengths))]
        text = " ".join("w." if i + 1 in ends else "w" for i in range(ends[-1]))
        pieces = split.bisect(text)
        assert all(b - a <= 600 for _, _, a, b in pieces) and all(p[3] - q[2] == 150 for p, q in zip(pieces, pieces[1:]))
        for cut in {p[3] for p in pieces} - set(ends):
            before, after = max((e for e in ends if 150 <= e < cut), default=0), min(e for e in ends if e > cut)
            assert after - before > (450 if before else 600)


def test_split_odd_rows(spark):
    long = "One two three. " * 500
    rows = [("a", "p", None, long, 100), ("a", "p", None, long, 100), ("b", None, "S", long, None), (None, "p", "S", long, 0), ("n", "p", "S", None, 0), ("e", "p", "S", "", 0), ("w", "p", "S", " " * 9000, 0), ("x", "p", "S", "y" * 90000, 0)]
    df = clashing(spark.createDataFrame(rows, "chunk_id string, paper_id string, section string, text string, char_offset int"))
    got = split.split_oversized(df).collect()
    assert {r["chunk_id"] for r in got} == {"a", "b", None} and all(r["n_words"] <= 600 for r in got)
    assert all(r["text"] == long[r["char_offset"] - 100 :][: len(r["text"])] and r["text"].endswith(".") for r in got if r["chunk_id"] == "a")
    assert split.split_oversized(df.limit(0)).count() == 0


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_scanned_chunk(spark):
    clean = "the membrane was however stable under the dose-dependent treatment and " * 200
    page = "the membrane was how-\never stab1e under the dose-\ndependent treatrnent and the mem­\nbrane\nJournal of Odd Things\n- 12 -\nwas stable under the\nA study of the memb\ntreatment and the end."
    rows = [(f"c{i}", "p", clean) for i in range(5)] + [(f"s{i}", "p", page + f" It was run {i}.") for i in range(3)] * 2 + [("n", None, None), ("e", None, ""), (None, "p", page), ("b", "p", " \n "), ("l", None, "x" * 50000)]
    df = clashing(spark.createDataFrame(rows, "chunk_id string, paper_id string, text string"))
    titles = spark.createDataFrame([("p", "A study of the membrane"), ("p", None)], "paper_id string, title string")
    out = scanned.repair_scans(df, titles)
    found = {(r["defect"], r["item"]) for r in scanned.defects(out).where("chunk_id = 's0'").collect()}
    assert found == {("split_word", "however"), ("split_word", "dose-dependent"), ("split_word", "membrane"), ("misread", "stable"), ("misread", "treatment"), ("running_head", "Journal of Odd Things"), ("running_head", "A study of the memb"), ("page_number", "- 12 -")}
    assert out.count() == 3 and out.where("chunk_id = 's0'").first()["text"] == "the membrane was however stable under the dose-dependent treatment and the membrane was stable under the treatment and the end. It was run 0."
    assert scanned.repair_scans(df.limit(0)).count() == 0


def test_only_page_edges_are_furniture(spark):
    text = "The model was first described in\n1984\nby others and the model of\ncivic\nduty was described\nin the model.\n\nACKNOWLEDGEMENTS\nThe model was described by others of\nduty and the model in the\nmodel was first described.\n\nxiv\n\nThe model was of the\nmodel and others in duty"
    rows = [(f"c{i}", f"p{i % 3}", f"{text} {i}.") for i in range(6)]
    df = spark.createDataFrame(rows, "chunk_id string, paper_id string, text string")
    out = scanned.repair_scans(df).collect()
    assert len(out) == 6
    for r in out:
        assert [(d["defect"], d["item"]) for d in r["defects"]] == [("page_number", "xiv")]
        assert "in 1984 by" in r["text"] and "civic duty" in r["text"] and "ACKNOWLEDGEMENTS" in r["text"]
    page = scanned.Page.of(["a text that", "    Journal of Things", "- 12 -", "goes on and", "17", "on", "", "18", "Then."])
    assert page.numbers() == {2, 4, 7} and [c[0] for c in page.candidates() if c[1] and c[2]] == [scanned.fold("Journal of Things")]
    reader = scanned.Reader({w: 1000 for w in ("the", "model", "others")})
    assert reader.right("rnodel") == "model" and reader.right("0thers") == "others" and reader.right("x" * 500) is None


@settings(max_examples=300, deadline=None)
@given(st.text("rnmlcidhuvw0o15s6bcefatqg", min_size=1, max_size=12), st.integers(0, 200))
def test_confusions_keep_the_strokes(word, pick):
    options = [word[:i] + was + word[i + len(wrong) :] for wrong, was in scanned.CONFUSIONS for i in range(len(word)) if word.startswith(wrong, i)]
    if options:
        assert options[pick % len(options)].translate(scanned.STROKES) == word.translate(scanned.STROKES)


@pytest.mark.parametrize("most", [0, 3, 9])
def test_words_beyond_the_broadcast_count_as_well(spark, monkeypatch, most):
    """A small broadcast gives what a large one gives: split, misread, hyphenated and suspended words, and names."""
    clean = ("the membrane was however stable under the dose-dependent treatment and pre- and postnatal " * 20 + "non-linear membrane antidisestablishment Zorbamil stable ") * 3
    page = "the membrane was how-\never stab1e under the dose-\ndependent treatrnent and the mem­\nbrane\nanti-\ndisesta-\nblishrnent was\nnon-\nlin-\near and pre-\nand postnatal Zorbarnil\nwas non-linea and the dose-dependent-treatrnent of\nmernbrane and how-\nevcr the end."
    rows = [(f"c{i}", "p", clean) for i in range(5)] + [(f"s{i}", f"p{i}", f"{page} It was run {i}.") for i in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, paper_id string, text string")
    entities = spark.createDataFrame([("Zorbamil", None)], "name string, aliases array<string>")
    repaired = lambda: sorted((r["chunk_id"], r["text"], str(r["defects"])) for r in scanned.repair_scans(df, entities=entities).collect())
    whole = repaired()
    assert len(whole) == 3 and "antidisestablishment" in whole[0][1] and "Zorbarnil" in whole[0][1]
    monkeypatch.setattr(scanned, "MOST_WORDS", most)
    assert repaired() == whole


def test_texts_ask_for_all_that_they_look_up():
    """With any vocabulary, a reader that has only the words of the places that a text asks for gives the same."""
    rng = random.Random(5)
    stems = ["".join(rng.choice("ariclnmdoe") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    word = lambda: rng.choice(["", "", "-"]).join(rng.choice(stems) for _ in range(rng.randint(1, 4)))
    for _ in range(60):
        vocabulary = {word(): rng.choice([4, 50, 5000]) for _ in range(400)}
        names = {w for w in vocabulary if rng.random() < 0.1}
        text = "\n".join(" ".join(word() for _ in range(rng.choice([1, 1, 3]))) + rng.choice(["-", "-", "", "­"]) for _ in range(40)) + "\nthe end"
        whole = scanned.Reader(vocabulary, names).repair(text, set())
        held = {w: n for w, n in vocabulary.items() if rng.random() < 0.3}
        asked = scanned.Asked(max(len(scanned.place_of(w)) for w in vocabulary))
        asked.repair(text, set())
        more = [{"word": w, "n": n, "name": w in names} for w, n in vocabulary.items() if w not in held and scanned.place_of(w) in asked.places]
        common = scanned.Reader(held, {w for w in names if w in held})
        assert scanned.ReaderOfText(common, more).repair(text, set()) == whole


# -- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokenize.encoder_for(tokenize.default_vocabulary())


@pytest.fixture(scope="module")
def public(encoder):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=encoder.vocabulary.rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab 'sre\n\t1²中文é—😀\x1c\x85　"), max_size=25), cut=st.tuples(st.integers(0, 25), st.integers(0, 6)), new=st.text("ab '1\n", max_size=4))
def test_encoding_equals_public_library(encoder, public, text, cut, new):
    ids = encoder.encode(text)
    assert ids == public.encode_ordinary(text)
    held = tokenize.EncodedText(encoder, text)
    held.STRIDE = 2
    held = held.edit(0, 0, text[:5]).edit(0, min(5, len(text)), "")
    assert held.text == text and held.ids == ids
    for at in (cut[0], cut[0] // 2, 25):
        start = min(at, len(held.text))
        end = min(len(held.text), start + cut[1])
        changed = held.text[:start] + new + held.text[end:]
        held.edit(start, end, new)
        assert held.text == changed and held.ids == public.encode_ordinary(changed)


def test_appends_are_exact_and_long_pieces_linear(encoder, public):
    word = "abcdef" * 3000
    t = tokenize.PrefixTable(encoder.vocabulary)
    for i in range(0, len(word), 1000):
        t.append(word[i : i + 1000].encode())
    assert t.ids() == public.encode_ordinary(word) == encoder.encode(word)


def test_small_edits_of_long_texts_are_local(encoder, public):
    rng = random.Random(3)
    text = " ".join(rng.choice(["membrane", "of", "the\n", "α-helix", "x1"]) for _ in range(200_000))
    held = tokenize.EncodedText(encoder, text)
    assert held.ids == public.encode_ordinary(text)
    began = time.perf_counter()
    encoder.encode(text)
    whole = time.perf_counter() - began
    took = []
    for _ in range(20):
        at = rng.randrange(len(held.text))
        began = time.perf_counter()
        held.edit(at, at + 1, "z")
        took.append(time.perf_counter() - began)
    assert held.ids == public.encode_ordinary(held.text) and sorted(took)[10] < whole / 10


def test_encode_corpus(spark, public):
    rows = [(1, "two words"), (1, "two words"), (2, None), (3, ""), (None, " "), (4, "<|endoftext|>")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["ids"]) for r in tokenize.encode_corpus(df).collect()), key=str)
    assert got == sorted([(k, public.encode_ordinary(t) if t else []) for k, t in rows], key=str)
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------


def test_budgets_go_to_siblings_first():
    t = [dict(domain="a", source=s, target_share=x, max_repeats=m) for s, x, m in (("s1", 0.3, 1), ("s2", 0.2, 2))] + [dict(domain="b", source="s3", target_share=0.5, max_repeats=9)]
    got = mixing.budgets(t, {"s1": 10, "s2": 100, "s3": 100}, ["domain", "source"], 100)
    assert got == pytest.approx({"s1": 10, "s2": 40, "s3": 50})
    got = mixing.budgets(t, {"s1": 10, "s3": 100}, ["domain", "source"], 100)
    assert got == pytest.approx({"s1": 10, "s2": 0, "s3": 90})


def test_source_tree_comes_from_data(spark):
    rows = [("a", "en")] * 19 + [("a", "de"), ("b", "fr"), ("b", "de"), (None, "en"), ("d", None)]
    documents = spark.createDataFrame(rows, "source string, lang string")
    targets = spark.createDataFrame([(s, 0.25, 1) for s in ("a", "b", "c", None)], "source string, target_share double, max_repeats int")
    domains = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "source string, domain string").limit(2)
    got = {r["source"]: (r["domain"], r["language"]) for r in catalog.source_tree(documents, targets, domains).collect()}
    assert got == {"a": ("x", "en"), "b": ("x", "many"), "c": ("c", "many"), None: (None, "many")}


def test_mix(spark):
    rows = [(i, "some words here " * (i % 9 + 1), "big" if i % 3 else "small") for i in range(300)] + [(900, None, "big"), (901, "", "big"), (902, "x", None), (903, "x", "other"), (None, "x", "big"), (5, "some words here " * 6, "big")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 2), ("gone", 0.05, 3), (None, None, None)], "source string, target_share double, max_repeats int")
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    mixture, report = mixing.mix(df, targets)
    chosen = mixture.collect()
    assert {r["doc_id"] for r in chosen} <= set(range(300)) and max(r["copies"] for r in chosen) <= 2 and len({r["doc_id"] for r in chosen}) == len(chosen)
    shares = {r["source"]: r for r in report.collect()}
    assert abs(shares["big"]["chosen_tokens"] - shares["big"]["budget"]) < 40 and shares["gone"]["actual_share"] == 0 and {"other", None} <= set(shares)
    assert math.isclose(sum(r["actual_share"] for r in shares.values()), 1)
    again = mixing.mix(df.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen))
    mixture, report = mixing.mix(df.limit(0), targets)
    assert mixture.count() == 0 and {r["actual_share"] for r in report.collect()} == {0.0}


# -- 9 -----------------------------------------------------------------------------------------------------------------


def test_labels_are_read(spark):
    rows = ["EN", " en-GB ", "eng", "English", "pt_BR", "zh-Hans", "und", "-", "", None, "de, fr", "Swedish"]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in rows], "l string").select(language.declared_codes(F.col("l")).alias("c")).collect()]
    assert got == [["en"], ["en"], ["en"], ["en"], ["pt"], ["zh"], [], [], [], [], ["de", "fr"], ["sv"]]


@pytest.fixture(scope="module")
def more_documents(spark):
    folder = Path("/root/testdata/sf0.01/documents.parquet")  # the smallest table has a handful of documents a language
    if not folder.exists():
        pytest.skip("no test data")
    return spark.read.parquet(str(folder))


def test_languages(spark, more_documents):
    documents = more_documents
    model = language.sample_and_fit(documents)
    en, de = "The patients received the drug every morning and were examined after two weeks.", "Die Ergebnisse sprechen dafür, dass die Behandlung bei älteren Erwachsenen wirksam ist."
    rows = [(1, en, "de"), (2, f"{en} {en}\n\n{de} {en}", "en"), (3, None, "en"), (4, "", "en"), (5, "  ", None), (6, "12 34\n5.6", "en"), (7, "ACGT" * 200, "en"), (8, (en + " ") * 3000, "xx"), (None, de, "de"), (1, en, "de")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labelled = language.label_languages(df, model)
    got = {r["doc_id"]: r for r in labelled.collect()}
    assert got[1]["lang_code"] == "en" and got[None]["lang_code"] == "de" and got[8]["lang_code"] == "en"
    assert [s["lang_code"] for s in got[2]["segments"]] == ["en", "de", "en"] and all(got[k]["lang_code"] is None and got[k]["segments"] == [] for k in (3, 4, 5, 6, 7))
    assert {tuple(r) for r in language.undeclared(labelled).collect()} == {(1, "en"), (2, "de"), (8, "en")}
    assert language.label_languages(df.limit(0), model).count() == 0


def test_languages_that_no_label_names_are_none(spark, more_documents):
    model = language.sample_and_fit(more_documents)
    assert set(model.codes) == {"de", "en", "es", "fr", "it", "nl", "pt", "ru", "zh"}
    other = [
        "Patienterna fick läkemedlet varje morgon och undersöktes efter två veckor. Resultaten visar att behandlingen är effektiv hos äldre vuxna.",
        "Pacjenci otrzymywali lek każdego ranka i byli badani po dwóch tygodniach. Wyniki wskazują, że leczenie jest skuteczne u osób starszych.",
        "Potilaat saivat lääkettä joka aamu ja heidät tutkittiin kahden viikon kuluttua. Tulokset osoittavat, että hoito on tehokas.",
    ]
    assert [j[0] for j in language.judge_all(model, other)] == [None, None, None]
    own = ["My dog likes to chase squirrels in the park, and yesterday he fell into the pond.", "Mein Hund jagt gern Eichhörnchen im Park, und gestern ist er in den Teich gefallen."]
    assert [j[0] for j in language.judge_all(model, own)] == ["en", "de"]
    near = language.judge_all(model, ["Els pacients van rebre el medicament cada matí i van ser examinats."])[0]
    assert near[0] is None or near[1] < 0.9


def test_held_out_accuracy(more_documents):
    rows = [r for r in more_documents.select("text", F.try_element_at(language.declared_codes(F.col("lang")), F.lit(1)).alias("code")).where("text IS NOT NULL AND code IS NOT NULL AND length(text) > 60").orderBy("text").collect()]
    train, held = rows[::2], rows[1::2]
    model = language.fit([r["text"] for r in train], [r["code"] for r in train])
    right = [j[0] == r["code"] for j, r in zip(language.judge_all(model, [r["text"] for r in held]), held)]
    assert sum(right) / len(right) >= 0.8  # a part of the labels is wrong by design


def test_foreign_stretch_costs_the_same_anywhere():
    for gain, taken in ((language.SWITCH - 2, 0), (language.SWITCH + 2, 1)):
        for at in range(7):
            for length in (1, 2):
                score = np.zeros((8, 3))
                score[:, 0] = 60
                stretch = slice(at, at + length)
                score[stretch, 1] = 60 + gain / length
                expected = np.zeros(8, int)
                expected[stretch] = taken
                assert (language._path(score) == expected).all(), (gain, at, length)


def test_empty_sample_gives_no_language(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.label_languages(df, language.sample_and_fit(df)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("chunks", "documents", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    df = catalog.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(result.fetchall())
