import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import agent
from graphloom.config import EngineConfig
from graphloom.graph import EDGE, KnowledgeGraph
from graphloom.operators import clean_graph, confidence, embed, extract, paths, recognize, resolve, retrieve, upserts, vector_index
from graphloom.operators.tree_aggregate import chunk_count, count, distinct, greatest, heavy_keys, least, mean, rounds_for, total, tree_aggregate
from graphloom.pipeline import Pipeline
from graphloom.plans import binding
from graphloom.plans.stage import drop_staged, only_kept, staged
from graphloom.sources.markdown import convert, read_markdown
from graphloom.streaming.incremental import mentions, stream_mentions

ENT = "label string, name string, aliases array<string>, umls_cui string"
MEN = "label string, name string, chunk_id string, count long"
EDG = ", ".join(f"{c} string" for c in EDGE) + ", evidence_count long"
EVI = ", ".join(f"{c} string" for c in EDGE) + ", chunk_id string, n long"


def graph(spark, entities=(), mentions_=(), edges=(), chunks=()):
    """Edges are given with their count and chunks, the first of which asserts what the others don't."""
    evidence = [(*e[:5], c, 1 if i else e[5] - len(e[6]) + 1) for e in edges for i, c in enumerate(e[6])]
    return KnowledgeGraph(
        spark.createDataFrame([("p", "P", None, None)], "paper_id string, title string, doi string, year int"),
        spark.createDataFrame(list(chunks), "chunk_id string, paper_id string, section string, chunk_index int, text string"),
        spark.createDataFrame(list(entities), ENT),
        spark.createDataFrame(list(mentions_), MEN),
        spark.createDataFrame([e[:6] for e in edges], EDG),
        spark.createDataFrame(evidence, EVI),
    )


def test_edges_count_assertions_and_keep_chunks_in_order(spark):
    rows = [("Gene", "a", "binds", "Gene", "b", "c2", 1), ("Gene", "a", "BINDS", "Gene", "b", "c2", 2), ("Gene", "a", "BINDS", "Gene", "b", "c1", 5), ("Gene", "a", "BINDS", "Gene", "b", "c2", 9)]
    evidence = upserts.upsert_evidence(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in EDGE) + ", chunk_id string, seq long"))
    got = {r["rel_type"]: r for r in upserts.with_chunk_ids(upserts.edges_of(evidence), evidence).collect()}
    assert got["ASSOCIATED_WITH"]["evidence_count"] == 1
    assert got["BINDS"]["evidence_count"] == 3 and got["BINDS"]["source_chunk_ids"] == ["c1", "c2"]


def test_entities_union_or_last_aliases(spark):
    rows = [(1, "Gene", "a", ["x"], "C1"), (2, "Gene", "a", ["y", "x"], None), (3, "Gene", "a", None, None), (4, "Planet", "a", None, None)]
    events = spark.createDataFrame(rows, "seq long, label string, name string, aliases array<string>, umls_cui string")
    loose = {r["label"]: r for r in upserts.upsert_entities(events).collect()}
    strict = {r["label"]: r for r in upserts.upsert_entities(events, True).collect()}
    assert loose["Gene"]["aliases"] == ["x", "y"] and loose["Gene"]["umls_cui"] == "C1" and strict["Gene"]["aliases"] == [] and "Mechanism" in loose


def test_intervals(spark):
    edges = [("Gene", "a", "BINDS", "Gene", "b", 1, ["c1"]), ("Gene", "a", "BINDS", "Gene", "a", 2, ["c1"]), ("Gene", "x", "BINDS", "Gene", "y", 0, []), ("Gene", "q", "BINDS", "Gene", "r", None, [])]
    men = [("Gene", n, c, 1) for n in "ab" for c in ("c1", "c2", "c3")]
    g = graph(spark, mentions_=men, edges=edges)
    got = {(r["src_name"], r["tgt_name"]): (r["k"], r["n"], r["confidence_lower"]) for r in confidence.edge_intervals(g.edges, g.mentions).collect()}
    assert got == {("a", "b"): (1, 3, 0.0615), ("a", "a"): (2, 2, 1.0), ("x", "y"): (1, 1, 1.0)}


def test_pairs_that_edges_join_both_ways_count_once(spark):
    edges = [("Gene", "a", "BINDS", "Gene", "b", 1, ["c1"]), ("Gene", "b", "TARGETS", "Gene", "a", 1, ["c1"])]
    men = [("Gene", n, c, 1) for n in "ab" for c in ("c1", "c2")]
    g = graph(spark, mentions_=men, edges=edges)
    assert sorted((r["src_name"], r["n_chunks"]) for r in confidence.comention_counts(g.edges, g.mentions).collect()) == [("a", 2), ("b", 2)]


def test_resolution_conserves_evidence_and_makes_loops(spark):
    ent = [("Gene", n, [], None) for n in ("TP53", "tp-53", "p53", "Tp 53")] + [("Protein", "p53", [], None)]
    men = [("Gene", "TP53", "c1", 1), ("Gene", "tp-53", "c1", 2), ("Gene", "Tp 53", "c2", 1), ("Gene", "Tp 53", "c3", 1), ("Gene", "p53", "c4", 1)]
    edges = [("Gene", "TP53", "BINDS", "Gene", "p53", 2, ["c1"]), ("Gene", "tp-53", "BINDS", "Gene", "p53", 2, ["c1", "c2"])]
    g = resolve.resolve(graph(spark, ent, men, edges), spark.createDataFrame([("P53 ", "TP53"), ("tp53", "TP53")], "alias string, canonical string"))
    assert {(r["label"], r["name"]) for r in g.entities.collect()} == {("Gene", "TP53"), ("Gene", "Tp 53"), ("Protein", "TP53")}
    assert sum(r["evidence_count"] for r in g.edges.collect()) == 4
    assert {r["name"]: r["aliases"] for r in g.entities.where("label = 'Gene'").collect()} == {"TP53": ["p53"], "Tp 53": ["tp-53"]}
    assert {(r["src_name"], r["tgt_name"], r["chunk_id"]): r["n"] for r in g.evidence.collect()} == {("TP53", "TP53", "c1"): 2, ("Tp 53", "TP53", "c1"): 1, ("Tp 53", "TP53", "c2"): 1}


def test_names_in_between_become_aliases(spark):
    ent = [("Gene", n, ["old"], None) for n in ("abc1", "ABC 1", "abc-1")]
    men = [("Gene", "ABC 1", f"c{i}", 1) for i in range(3)]
    g = resolve.resolve(graph(spark, ent, men), spark.createDataFrame([("abc1", "Abc-1")], "alias string, canonical string"))
    assert [(r["name"], r["aliases"]) for r in g.entities.collect()] == [("ABC 1", ["Abc-1", "abc-1", "abc1", "old"])]


def test_cleaning(spark):
    ent = [("Gene", n, [], None) for n in ("alone", "x", "1.5", "the of", "ok")]
    men = [("Gene", n, "c", 1) for n in ("x", "1.5", "the of", "ok")]
    g = graph(spark, ent, men, [("Gene", "ok", "BINDS", "Gene", "ok", 1, ["c"])])
    assert tuple(clean_graph.clean_stats(g).first()) == (1, 2, 1, 1)
    c = clean_graph.clean(g)
    assert [r["name"] for r in c.entities.collect()] == ["ok"] and c.edges.count() == 0 and c.mentions.count() == 1


def test_paths(spark):
    e = [("Gene", a, "BINDS", "Gene", b, 1, []) for a, b in ("ab", "bc", "cd", "de", "ef", "az", "zc")]
    edges = graph(spark, edges=e).all_edges()
    assert paths.shortest_path(edges, ("Gene", "a"), ("Gene", "c")).first()["nodes"] == ["a", "b", "c"]
    assert paths.shortest_path(edges, ("Gene", "e"), ("Gene", "a"), 4).first()["nodes"] == ["e", "d", "c", "b", "a"]
    assert paths.shortest_path(edges, ("Gene", "a"), ("Gene", "f"), 4).count() == 0 == paths.shortest_path(edges, ("Gene", "a"), ("Gene", "a")).count()
    assert {r["key"]: r["hops"] for r in paths.hop_distances(edges, ("Gene", "a"), 2).collect()} == {"a": 0, "b": 1, "z": 1, "c": 2}


def test_retrieval(spark):
    chunks = [(f"p__{i:04d}", "p", "S", i, f"text {i} alpha" if i % 2 else "other") for i in range(8)]
    men = [("Gene", "g", f"p__{i:04d}", 1) for i in range(4, 8)] + [("Gene", "g", "p__0000", 1)]
    g = graph(spark, [("Gene", "gamma", None, None), ("Gene", "g", ["Alpha one"], None)], men, chunks=chunks)
    v = spark.createDataFrame([(f"p__{i:04d}", [1.0, float(i)]) for i in range(8)] + [("bad", [1.0])], "key string, embedding array<float>")
    rows = retrieve.hybrid_search(g, v, [1.0, 0.0], "ALPHA", 2, True).orderBy("pos").collect()
    assert [r["chunk_id"] for r in rows] == ["p__0000", "p__0001", "p__0003", "p__0004"]
    assert [r["name"] for r in retrieve.search_entity(g.entities, "alpha").collect()] == ["g"]
    assert retrieve.chunk_lookup(g.chunks, "no").first()["text"] == "Chunk not found"
    assert tuple(retrieve.edge_lookup(g.with_(edges=confidence.edge_intervals(g.edges, g.mentions)), ("Gene", "a"), "binds", ("Gene", "b")).first()) == (None, None, 0)


def test_tolerant_json_and_fallbacks(spark):
    def broken(text, hints):
        raise ValueError

    rows = spark.createDataFrame([("t a b", "  - a (Gene)\n  - b (Drug)")], "text string, hints string")
    raw = extract.extract(rows, [broken, extract.pattern_extractor])
    assert [r["name"] for r in extract.valid_entities(raw).collect()] == ["a", "b"]
    rel = extract.valid_relationships(raw).first()
    assert (rel["source_name"], rel["relationship"], rel["evidence"]) == ("a", "ASSOCIATED_WITH", "a b")


def test_agent_pages_through_all_relationships(spark):
    edges = [("Gene", "hub", "BINDS", "Drug", f"d{i:03d}", 1 + i % 7, ["c"]) for i in range(130)]
    edges += [("Drug", f"d{i:03d}", "INHIBITS", "Gene", "hub", 1 + i % 5, ["c"]) for i in range(120)]
    box = agent.Toolbox(graph(spark, edges=edges).with_(chunks=spark.createDataFrame([], "chunk_id string, text string")), None)

    def planner(question, trace):
        if trace and len(trace[-1]["output"]) < 100:
            return "read"
        return [("get_entity_relationships", {"entity_type": "Gene", "entity_name": "hub", "page": len(trace)})]

    trace = agent.ask("?", box, planner)[3]
    assert [len(t["output"]) for t in trace] == [100, 100, 50]
    rows = [r for t in trace for r in t["output"]]
    assert len({(r["direction"], r["other_name"]) for r in rows}) == 250
    assert rows == sorted(rows, key=lambda r: (-r["evidence_count"], r["other_name"], r["other_label"], r["rel_type"], r["direction"]))


def test_pipeline_and_agent(spark):
    docs = spark.createDataFrame([("d", "## One\nAlpha binds beta. Alpha is old.\n## Two\nbeta and gamma.")], "paper_id string, text string")
    papers = spark.createDataFrame([("d", "T", None, None)], "paper_id string, title string, doi string, year int")
    p = Pipeline(recognize.Gazetteer([("alpha", "Gene"), ("beta", "Drug"), ("gamma", "Disease")]))
    g = p.build(docs, papers)
    assert {(r["src_name"], r["tgt_name"]) for r in g.edges.collect()} == {("Alpha", "beta"), ("beta", "gamma")}
    synonyms = spark.createDataFrame([("gamma", "Gamma disease")], "alias string, canonical string")
    assert "Gamma disease" in {r["name"] for r in p.refined(g, synonyms).entities.collect()}
    vectors = embed.embed(embed.chunk_texts(g.chunks)).select("key", "embedding")
    answer, evidence, record, trace = agent.ask("What does Alpha bind?", agent.Toolbox(g, vectors))
    assert evidence and record["label"] in ("High", "Medium", "Low") and "Alpha" in answer and trace
    assert "Unknown tool" in agent.Toolbox(g, vectors).execute("nothing", {}).first()["error"]
    assert all(t.schema()["input_schema"]["type"] == "object" for t in agent.TOOLS)


def test_tree_aggregation_equals_plain(spark):
    df = spark.range(0, 3000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("n"), F.lit(1).alias("__node"))
    got = tree_aggregate(df.drop("__node"), ["k"], [count("c"), count("m", F.col("n")), total("n", F.col("n")), least("lo", F.col("n")), greatest("hi", F.col("n")), mean("av", F.col("n"))], chunk_rows=10, fan_in=4)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count("n").alias("m"), F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("av"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    for rounds in (1, 2, 5):
        assert sorted(map(tuple, tree_aggregate(df, ["k"], [count("c"), total("n", F.col("n"))], chunk_rows=10, fan_in=4, rounds=rounds).collect()), key=str) == sorted(((r["k"], r["c"], r["n"]) for r in plain.collect()), key=str)
    near = {r["k"]: r["d"] for r in tree_aggregate(df, ["k"], [distinct("d", F.col("n"))], chunk_rows=10, fan_in=4).collect()}
    assert abs(near["hot"] - 800) < 40
    assert [tuple(r) for r in heavy_keys(df, "k", 0.2).collect()] == [("k", "hot", 1000)]
    assert tree_aggregate(df.limit(0), ["k"], [count("c")]).count() == 0


def test_rounds_follow_the_chunks(spark):
    assert [rounds_for(n, 16) for n in (1, 16, 17, 256, 257, 10**9)] == [1, 1, 2, 2, 3, 8]
    assert chunk_count(spark.range(0, 105, numPartitions=5), 10) == 15 and chunk_count(spark.range(0), 10) == 1


def test_staged_tables(spark):
    df = staged(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.applicationId in df.inputFiles()[0]
    drop_staged(df)
    with pytest.raises(Exception, match="exist"):
        df.collect()


def test_scopes_leave_only_what_is_kept(spark):
    with only_kept(spark) as kept:
        gone = staged(spark.range(3))
        kept.append(staged(spark.range(4)))
    assert kept[0].count() == 4
    with pytest.raises(Exception, match="exist"):
        gone.collect()


def test_markdown_and_converters(spark, tmp_path):
    (tmp_path / "one.md").write_bytes(b"a\r\nb")
    (tmp_path / "two.txt").write_text("no")
    (tmp_path / "x.pdf").write_bytes(b"y" * 300)
    assert [tuple(r) for r in read_markdown(spark, str(tmp_path)).collect()] == [("one", "a\nb")]

    def fails(content):
        raise ValueError("no")

    good = convert(spark, str(tmp_path), [fails, lambda b: b.decode()]).first()
    assert good["paper_id"] == "x" and len(good["text"]) == 300 and good["error"] is None
    assert convert(spark, str(tmp_path), [fails]).first()["error"] == "no"
    assert convert(spark, str(tmp_path), [fails], done=spark.createDataFrame([("x",)], "paper_id string")).count() == 0


def test_streamed_mentions_are_taken_once(spark, tmp_path):
    rows = spark.createDataFrame([("Gene", "a", "c1"), ("Gene", "a", "c1"), (None, "a", "c1")], "label string, canonical_name string, chunk_id string")
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        stream_mentions(spark, source, rows.schema, target, check)
    assert [tuple(r) for r in mentions(spark, target).collect()] == [("Gene", "a", "c1", 4)]


def test_command_line_build_and_resume(spark, tmp_path):
    from graphloom.__main__ import build, load

    docs, out = tmp_path / "docs", str(tmp_path / "out")
    docs.mkdir()
    (docs / "one.md").write_text("# T\n\n## A\nAlpha binds beta.")
    names = spark.createDataFrame([("Gene", "alpha"), ("Drug", "beta")], "label string, name string")
    build(spark, str(docs), out, names, skip_embed=True)
    (docs / "two.md").write_text("## B\nAlpha binds beta again.")
    g = load(spark, build(spark, str(docs), out, names, resume=True, skip_embed=True))
    edge = g.edges.first()
    assert edge["evidence_count"] == 2 and g.evidence.count() == 2 and g.chunks.count() == 3 and {r["title"] for r in g.papers.collect()} == {"T", "two"}
    again = load(spark, build(spark, str(docs), out, names, resume=True, skip_embed=True))
    assert again.edges.first()["evidence_count"] == 2 and again.evidence.count() == 2 and again.chunks.count() == 3

    def asked(text, hints):
        raise AssertionError("a cached text is asked for again")

    cached = load(spark, build(spark, str(docs), out, names, clear=True, skip_embed=True, extractors=[asked]))
    assert cached.edges.first()["evidence_count"] == 2
    rows = cached.run("SELECT chunk_id FROM evidence WHERE src_name = :name AND n >= :least ORDER BY chunk_id", name="Alpha", least=1).collect()
    assert len(rows) == 2 and cached.run("SELECT count(*) AS n FROM evidence WHERE src_name = :name", name="x' OR '1' = '1").first()["n"] == 0
    assert cached.cleared().edges.count() == 0


def test_command_line_converts_once(spark, tmp_path):
    from graphloom.__main__ import build, load

    docs, pdfs, out = tmp_path / "docs", tmp_path / "pdfs", str(tmp_path / "out")
    docs.mkdir()
    pdfs.mkdir()
    body = "A STUDY OF IT\nFigure 1. A picture\n" + "\n".join(f"Alpha binds beta {i}." for i in range(20))
    (pdfs / "p.pdf").write_bytes(body.encode())
    names = spark.createDataFrame([("Gene", "alpha"), ("Drug", "beta")], "label string, name string")
    g = load(spark, build(spark, str(docs), out, names, skip_embed=True, pdfs=str(pdfs), converters=[lambda b: b.decode()]))
    text = "".join(r["text"] for r in g.chunks.collect())
    assert g.papers.first()["paper_id"] == "p" and "> Figure 1" in text and g.edges.count() == 1
    (pdfs / "q.pdf").write_bytes(body.encode())

    def fails(content):
        raise ValueError

    g = load(spark, build(spark, str(docs), out, names, skip_embed=True, pdfs=str(pdfs), converters=[fails]))
    assert {r["paper_id"] for r in g.papers.collect()} == {"p"}


def test_merged_papers_keep_titles(spark):
    kind = "paper_id string, title string, doi string, year int"
    old = graph(spark).with_(papers=spark.createDataFrame([("a", "Old", "d", None), ("b", "Old", None, 1)], kind))
    new = graph(spark).with_(papers=spark.createDataFrame([("a", "", None, 7), ("b", "New", "e", 2), ("c", "", None, None)], kind))
    assert sorted(map(tuple, upserts.merged(old, new).papers.collect())) == [("a", "Old", "d", 7), ("b", "New", "e", 1), ("c", "", None, None)]


def test_recognisers_fail_softly_and_add_up(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "bad alpha"), ("c3", None)], "chunk_id string, text string")

    def first(text):
        if "bad" in text:
            raise ValueError
        return [("alpha", "GENE", 0, 5, None, None, 1.0)]

    def missing():
        raise ImportError

    second = recognize.PerWorker(lambda: recognize.Gazetteer([("alpha", "Gene"), ("beta", "DISEASE")]), "names")
    p = Pipeline(first, second=second)
    got = {(r["chunk_id"], r["text"], r["label"], r["pass"]) for r in p.recognized(chunks).collect()}
    assert got == {("c1", "alpha", "GENE", 1), ("c1", "beta", "Disease", 2), ("c2", "alpha", "Gene", 2)}
    absent = Pipeline(recognize.PerWorker(missing, "absent", lambda text: []), second=second)
    assert {r["pass"] for r in absent.recognized(chunks).collect()} == {2}


def test_vector_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 20)
    rng = np.random.default_rng(2)
    rows = [("Gene" if i % 2 else "Drug", f"k{i:03d}", rng.normal(size=8).tolist()) for i in range(200)] + [("Gene", "nan", [float("nan")] * 8), ("Gene", "zero", [0.0] * 8), ("Gene", "null", None), ("Gene", "short", [1.0])]
    nodes = spark.createDataFrame(rows, "label string, key string, embedding array<double>")
    folder = str(tmp_path / "index")
    vector_index.VectorIndex.write(nodes, folder)
    index = vector_index.VectorIndex.read(spark, folder)
    query = rows[7][2]
    exact = [r["key"] for r in embed.nearest(nodes.where("size(embedding) = 8"), query, 5, label="Gene").collect()]
    assert [r["key"] for r in index.search(spark, query, 5, "Gene", probes=100).collect()] == exact and exact[0] == "k007"
    assert index.search(spark, query, 1, probes=1).first()["key"] == "k007"
    assert vector_index.VectorIndex.write(nodes.limit(0), folder).search(spark, query, 3).count() == 0


def test_environment_and_calibration(spark):
    assert EngineConfig.from_env(environ={"GRAPHLOOM_WINDOW": "300", "GRAPHLOOM_ALPHA": "0.1"}) == EngineConfig(window=300, alpha=0.1)
    prompt = agent.calibration_prompt("What binds alphaone?", "It.", ["alphaone " * 500, "no", "alphaone"])
    assert len(prompt) < 1000 and agent.offline_calibrator(prompt)["evidence_count"] == 2

def test_evidence_ids_keep_first_places(spark):
    trace = spark.createDataFrame([(2, 0, "p__1"), (1, 0, "p__2"), (3, 1, "p__1"), (1, 1, "other"), (1, 2, None)], "seq int, pos int, id string")
    assert [tuple(r) for r in retrieve.evidence_ids(trace).orderBy("pos").collect()] == [(1, "p__2"), (2, "p__1")]


def test_overwritten_intervals_and_vectors(spark):
    g = graph(spark, edges=[("Gene", "a", "BINDS", "Gene", "b", 1, ["c1"]), ("Gene", "a", "BINDS", "Gene", "c", 1, ["c1"])])
    new = g.edges.where("tgt_name = 'b'").withColumn("evidence_count", F.lit(7).cast("long")).withColumn("confidence_lower", F.lit(0.1)).withColumn("confidence_upper", F.lit(0.2))
    got = {r["tgt_name"]: (r["evidence_count"], r["confidence_lower"]) for r in upserts.overwrite_confidence(g.edges, new).collect()}
    assert got == {"b": (7, 0.1), "c": (1, None)}
    nodes = spark.createDataFrame([("x",), ("y",)], "key string")
    vectors = spark.createDataFrame([("x", [1.0])], "key string, embedding array<float>")
    assert {r["key"]: r["embedding"] for r in upserts.set_embeddings(nodes, vectors, ["key"]).collect()} == {"x": [1.0], "y": None}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [confidence.MOST_WORDS, 1])
def test_comentions_of_many_pairs_are_counted_without_a_broadcast_of_pairs(spark, monkeypatch, most):
    """Also where the filter is too small for its pairs and lets most others pass; an entity may be in all chunks or in none."""
    monkeypatch.setattr(confidence, "MOST_WORDS", most)
    draw = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    chunks = {f"c{i}": {"n0", *draw.sample(names, draw.randint(1, 12))} for i in range(200)}
    pairs = {(draw.choice(names), draw.choice([*names, "absent"])) for _ in range(500)}
    mentions = spark.createDataFrame([("Gene", n, c) for c, all_ in chunks.items() for n in all_], "label string, name string, chunk_id string")
    edges = spark.createDataFrame([("Gene", a, "BINDS", "Gene", b) for a, b in pairs], "src_label string, src_name string, rel_type string, tgt_label string, tgt_name string")
    counts = confidence.comention_counts(edges, mentions.unionByName(mentions))
    assert "Broadcast" not in _plan(counts)
    want = {(a, b): n for a, b in pairs if a != b and (n := sum(a in c and b in c for c in chunks.values()))}
    assert {(r["src_name"], r["tgt_name"]): r["n_chunks"] for r in counts.collect()} == want


def test_comentions_without_pairs_or_mentions(spark):
    edges = spark.createDataFrame([("Gene", "a", "BINDS", "Gene", "b")], "src_label string, src_name string, rel_type string, tgt_label string, tgt_name string")
    mentions = spark.createDataFrame([("Gene", "a", "c"), ("Gene", "b", "c")], "label string, name string, chunk_id string")
    assert confidence.comention_counts(edges.limit(0), mentions).count() == 0
    assert confidence.comention_counts(edges, mentions.limit(0)).count() == 0
    assert [r["n_chunks"] for r in confidence.comention_counts(edges, mentions).collect()] == [1]


def test_resolution_broadcasts_no_names(spark, data):
    """The files of staged names say little about their size in the driver's memory."""
    g = binding.written(spark, data, stage=True)
    mapping = resolve.name_map(g, spark.createDataFrame([("a", "b")], "alias string, canonical string"))
    assert "Broadcast" not in _plan(mapping)
