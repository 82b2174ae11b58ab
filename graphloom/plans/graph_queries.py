"""Queries over the graph: building, intervals, resolution, cleaning, texts of nodes, retrieval and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.config import LABELS, PHRASES, STOPWORDS
from graphloom.functions import stats
from graphloom.functions import text as T
from graphloom.graph import EDGE
from graphloom.operators import clean_graph, confidence, embed, paths, resolve, retrieve, upserts, vector_index
from graphloom.plans import binding as B
from graphloom.plans.text_queries import sql_strip, sql_words
from graphloom.plans.stage import fresh_folder, staged
from graphloom.sources.tables import table


def edge_confidence(spark, d):
    g = B.staged_graph(spark, d)
    return confidence.edge_intervals(g.edges, g.mentions)


def edge_confidence_wilson(spark, d):
    g = B.staged_graph(spark, d)
    return confidence.edge_intervals(g.edges, g.mentions, boundary="wilson").select(*EDGE, "confidence_lower", "confidence_upper")


def wilson_grid(spark, d):
    n = spark.range(0, 201).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("k"))
    return n.select("k", "n", stats.wilson(F.col("k"), F.col("n")).alias("ci")).select("k", "n", "ci.lower", "ci.upper")


def upsert_entities(spark, d, strict=False):
    spans = B.spans(spark, d)
    events = spans.select(F.col("span_id").alias("seq"), F.coalesce("label", "raw_label").alias("label"), F.col("canonical_name").alias("name"), F.when(F.col("text").isNotNull(), F.array("text")).alias("aliases"), "umls_cui")
    return upserts.upsert_entities(events, strict)


def resume_pending(spark, d):
    g = B.graph(spark, d)
    return upserts.pending_chunks(g.chunks, g.mentions).select("chunk_id", "paper_id")


def overwrite_confidence(spark, d):
    """Intervals written back to the edges with more than one assertion."""
    g = B.staged_graph(spark, d)
    scored = confidence.edge_intervals(g.edges, g.mentions)
    return upserts.overwrite_confidence(g.edges, scored.where("evidence_count > 1"))


def set_embedding(spark, d):
    vectors = table(spark, d, "vectors").dropDuplicates(["key"]).withColumnRenamed("key", "chunk_id")
    return upserts.set_embeddings(B.chunks(spark, d), vectors, ["chunk_id"]).select("chunk_id", F.size("embedding").alias("dim"))


def resolve_synonyms(spark, d):
    return resolve.synonym_map(B.written(spark, d).entities, table(spark, d, "synonyms"))


def resolve_normalized(spark, d):
    g = B.written(spark, d)
    return resolve.normal_map(g.entities, g.mentions)


def resolved(spark, d):
    return resolve.resolve(B.written(spark, d, stage=True), table(spark, d, "synonyms"))


def resolved_edges(spark, d):
    g = resolved(spark, d)
    return g.evidence.groupBy(*EDGE).agg(F.sum("n").alias("evidence_count"), F.count(F.lit(1)).cast("int").alias("n_chunks"))


def resolved_mentions(spark, d):
    return resolved(spark, d).mentions


def resolved_entities(spark, d):
    return resolved(spark, d).entities.select("label", "name", F.array_join("aliases", "|").alias("aliases"))


def resolved_confidence(spark, d):
    g = clean_graph.clean(resolved(spark, d))
    return confidence.edge_intervals(g.edges, g.mentions).select(*EDGE, "k", "n", "confidence_lower", "confidence_upper")


def clean_isolated(spark, d):
    return clean_graph.without_isolated(B.noisy(spark, d)).entities.select("label", "name")


def clean_trivial(spark, d):
    return clean_graph.without(B.noisy(spark, d), clean_graph.is_trivial).mentions


def clean_stopwords(spark, d):
    return clean_graph.without(B.noisy(spark, d), clean_graph.is_stopwords).entities.select("label", "name")


def clean_self_loops(spark, d):
    return clean_graph.without_loops(B.graph(spark, d)).edges.select(*EDGE, "evidence_count")


def node_texts(spark, d):
    g = B.staged_graph(spark, d)
    return embed.entity_texts(g.entities, g.edges)


def knn_vectors(spark, d):
    e = table(spark, d, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return embed.nearest(e, query, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _query_vector(spark, d):
    v = table(spark, d, "vectors").where((F.size("embedding") == 64) & ~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0))
    return v.orderBy("key").select("embedding").first()[0]


def _vectors(spark, d):
    return table(spark, d, "vectors").where(F.size("embedding") == 64).dropDuplicates(["key"])


def knn_chunks(spark, d):
    return embed.nearest(_vectors(spark, d), _query_vector(spark, d), 10).select("key", F.round("score", 6).alias("score"))


def rank_papers(spark, d):
    joined = B.chunks(spark, d).join(_vectors(spark, d).withColumnRenamed("key", "chunk_id"), "chunk_id")
    return retrieve.rank_papers(joined, _query_vector(spark, d)).select("paper_id", F.round("score", 6).alias("score"))


def run_query(spark, d):
    """A read-only query with parameters over the graph's tables."""
    query = "SELECT rel_type, tgt_label, count(*) AS n, sum(evidence_count) AS evidence FROM edges WHERE src_label = :label AND evidence_count >= :least GROUP BY rel_type, tgt_label"
    return B.graph(spark, d).run(query, label="Gene", least=2)


def vector_index_search(spark, d):
    """The stored vectors through their index, with all cells read: the same as without it."""
    index = vector_index.VectorIndex.write(_vectors(spark, d), fresh_folder(spark, "index"))
    return index.search(spark, _query_vector(spark, d), 10, label="Chunk", probes=len(index.centres)).select("key", F.round("score", 6).alias("score"))


def _edges_with_chunks(g):
    evidence = staged(g.evidence, "evidence")
    return upserts.with_chunk_ids(upserts.edges_of(evidence), evidence)


def knn_label(spark, d):
    """The vectors of one label nearest to another one."""
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string"))
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return embed.nearest(e, query, 10, "vec_id", label="3").select("vec_id", F.round("score", 6).alias("score"))


def hybrid(expand):
    def query(spark, d):
        g = B.staged_graph(spark, d) if expand else B.graph(spark, d)
        found = retrieve.hybrid_search(g, _vectors(spark, d), _query_vector(spark, d), "Blinded", 5, expand)
        return found.select("pos", "chunk_id", "paper_id", "section", F.round("score", 6).alias("score"))

    return query


def of_hub(make, n=1):
    def query(spark, d):
        g = B.staged_graph(spark, d)
        return make(g, *B.hubs(g, n))

    return query


def scored(g):
    return g.with_(edges=confidence.edge_intervals(g.edges, g.mentions))


def hop_distances(spark, d):
    g = B.staged_graph(spark, d)
    return paths.hop_distances(g.all_edges(), B.hubs(g, 1)[0], 3)


def shortest_path(spark, d):
    """Between two of the rarest entities, the first one by name and the last one."""
    g = B.staged_graph(spark, d)
    counts = g.mentions.groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))
    first, last = counts.orderBy("n", "label", "name").first(), counts.orderBy("n", F.desc("label"), F.desc("name")).first()
    return paths.shortest_path(g.all_edges(), (first["label"], first["name"]), (last["label"], last["name"]), 4)


def _evidence(g):
    return [r[0] for r in g.chunks.where("text IS NOT NULL").orderBy("chunk_id").select("chunk_id").limit(8).collect()]


def on_graph(make):
    return lambda spark, d: make(B.graph(spark, d))


def _first_paper(g):
    return g.papers.orderBy("paper_id").first()["paper_id"]


def queries():
    return {
        "edge_confidence": edge_confidence,
        "edge_confidence_wilson": edge_confidence_wilson,
        "wilson_grid": wilson_grid,
        "upsert_papers": B.papers,
        "upsert_chunks": lambda s, d: upserts.upsert_chunks(table(s, d, "chunks")).select("chunk_id", "section", "chunk_index", "text"),
        "upsert_entities": lambda s, d: upsert_entities(s, d).withColumn("aliases", F.array_join("aliases", "|")),
        "upsert_entities_strict": lambda s, d: upsert_entities(s, d, True).withColumn("aliases", F.array_join("aliases", "|")),
        "upsert_mentions": on_graph(lambda g: g.mentions),
        "upsert_edges": lambda s, d: _edges_with_chunks(B.graph(s, d)),
        "overwrite_confidence": overwrite_confidence,
        "set_embedding": set_embedding,
        "resume_pending": resume_pending,
        "resolve_synonyms": resolve_synonyms,
        "resolve_normalized": resolve_normalized,
        "resolved_edges": resolved_edges,
        "resolved_mentions": resolved_mentions,
        "resolved_entities": resolved_entities,
        "resolved_confidence": resolved_confidence,
        "clean_isolated": clean_isolated,
        "clean_trivial": clean_trivial,
        "clean_stopwords": clean_stopwords,
        "clean_self_loops": clean_self_loops,
        "clean_stats": lambda s, d: clean_graph.clean_stats(B.noisy(s, d, stage=True)),
        "node_texts": node_texts,
        "chunk_texts": on_graph(lambda g: embed.chunk_texts(g.chunks)),
        "knn_vectors": knn_vectors,
        "knn_chunks": knn_chunks,
        "knn_label": knn_label,
        "run_query": run_query,
        "vector_index_search": vector_index_search,
        "rank_papers": rank_papers,
        "entity_relationships": of_hub(lambda g, h: retrieve.relationships(g, *h)),
        "entity_relationships_strict": of_hub(lambda g, h: retrieve.relationships(g, *h, strict=True)),
        "edge_lookup": of_hub(lambda g, a, b: retrieve.edge_lookup(scored(g), a, "associated_with", b), 2),
        "chunk_lookup": on_graph(lambda g: retrieve.chunk_lookup(g.chunks, _evidence(g)[0]).unionByName(retrieve.chunk_lookup(g.chunks, "no such chunk"))),
        "search_entity": on_graph(lambda g: retrieve.search_entity(g.entities, "AN").withColumn("aliases", F.coalesce(F.array_join("aliases", "|"), F.lit("-")))),
        "keyword_chunks": on_graph(lambda g: retrieve.keyword_chunks(g.chunks, "Blinded")),
        "hybrid_search": hybrid(False),
        "hybrid_search_expand": hybrid(True),
        "hop_distances": hop_distances,
        "shortest_path": shortest_path,
        "graph_stats_nodes": on_graph(retrieve.node_counts),
        "graph_stats_edges": on_graph(retrieve.edge_counts),
        "sidebar_totals": on_graph(retrieve.totals),
        "explorer_search": on_graph(lambda g: retrieve.search_entity(g.entities, "an", limit=5, aliases=False).select("label", "name")),
        "explorer_table": of_hub(lambda g, h: retrieve.relationship_table(scored(g), *h)),
        "paper_list": on_graph(lambda g: g.papers.select("paper_id", "title").orderBy("paper_id")),
        "chunk_browser": on_graph(lambda g: retrieve.chunk_browser(g.chunks, _first_paper(g))),
        "chunk_entities": on_graph(lambda g: retrieve.chunk_entities(g, _evidence(g)[0])),
        "subgraph_nodes": on_graph(lambda g: retrieve.subgraph(g, _evidence(g))[0]),
        "subgraph_edges": on_graph(lambda g: retrieve.subgraph(g, _evidence(g))[1]),
        "evidence_passages": on_graph(lambda g: retrieve.evidence_passages(g.chunks, _evidence(g))),
    }


Z = repr(stats.z_score())
E5 = "src_label, src_name, rel_type, tgt_label, tgt_name"


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    p, z = f"(CAST({k} AS DOUBLE) / {n})", Z
    scale = f"(1 + {z} * {z} / {n})"
    middle = f"(({p} + {z} * {z} / (2 * {n})) / {scale})"
    reach = f"(({z} / {scale}) * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    return f"round(greatest(0.0, {middle} - {reach}), 4)", f"round(least(1.0, {middle} + {reach}), 4)"


def sql_ci(k: str, n: str) -> str:
    lo, hi = sql_wilson(k, n)
    return f"""CASE WHEN {n} = 0 THEN 0.0 WHEN {k} = 0 THEN 0.0 WHEN {k} = {n} THEN 1.0 ELSE {lo} END AS confidence_lower,
        CASE WHEN {n} = 0 THEN 1.0 WHEN {k} = 0 THEN 0.0 WHEN {k} = {n} THEN 1.0 ELSE {hi} END AS confidence_upper"""


def sql_scored(edges: str = "edg", men: str = "men") -> str:
    return f"""com AS (SELECT e.src_label, e.src_name, e.tgt_label, e.tgt_name, count(DISTINCT a.chunk_id) AS n
          FROM (SELECT DISTINCT src_label, src_name, tgt_label, tgt_name FROM {edges} WHERE NOT (src_label = tgt_label AND src_name = tgt_name)) e
          JOIN {men} a ON a.label = e.src_label AND a.name = e.src_name JOIN {men} b ON b.label = e.tgt_label AND b.name = e.tgt_name AND b.chunk_id = a.chunk_id GROUP BY 1, 2, 3, 4)
, kn AS (SELECT e.*, greatest(evidence_count, 1) AS k, greatest(coalesce(n, 0), evidence_count, 1) AS n FROM {edges} e LEFT JOIN com c USING (src_label, src_name, tgt_label, tgt_name))
, sco AS (SELECT *, {sql_ci('k', 'n')} FROM kn)"""


NORM = rf"""{sql_strip(rf"regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x0b\x1c-\x1f\x85]', ' ', 'g'), '{T.WS}+', ' ', 'g')")}"""
SYN = f"""syn AS (SELECT lower({sql_strip('alias')}) AS key, min(canonical) AS canonical FROM synonyms WHERE alias IS NOT NULL AND canonical IS NOT NULL GROUP BY 1)
, m1 AS (SELECT label, name, canonical FROM went JOIN syn ON syn.key = lower({sql_strip('name')}) WHERE lower(canonical) <> key)"""


def sql_renamed(ent: str, men: str, edg: str, m: str, out: str) -> str:
    return f"""
, {out}men AS (SELECT a.label, coalesce(m.canonical, a.name) AS name, chunk_id, CAST(sum(count) AS BIGINT) AS count FROM {men} a LEFT JOIN {m} m ON m.label = a.label AND m.name = a.name GROUP BY 1, 2, 3)
, {out}ali AS (SELECT a.label, coalesce(m.canonical, a.name) AS name, unnest(list_append(a.aliases, a.name)) AS alias FROM {ent} a LEFT JOIN {m} m ON m.label = a.label AND m.name = a.name)
, {out}ent AS (SELECT label, name, list_sort(list(DISTINCT alias) FILTER (WHERE alias <> name)) AS aliases FROM {out}ali GROUP BY 1, 2)
, {out}raw AS (SELECT e.src_label, coalesce(x.canonical, e.src_name) AS src_name, rel_type, e.tgt_label, coalesce(y.canonical, e.tgt_name) AS tgt_name, evidence_count, source_chunk_ids
     FROM {edg} e LEFT JOIN {m} x ON x.label = e.src_label AND x.name = e.src_name LEFT JOIN {m} y ON y.label = e.tgt_label AND y.name = e.tgt_name)
, {out}edg AS (SELECT {E5}, CAST(sum(evidence_count) AS BIGINT) AS evidence_count, list_sort(list_distinct(flatten(list(source_chunk_ids)))) AS source_chunk_ids FROM {out}raw GROUP BY 1, 2, 3, 4, 5)"""


def sql_normal(ent: str, men: str, out: str) -> str:
    return f"""
, {out}n AS (SELECT e.label, e.name, {NORM.replace('lower(name)', 'lower(e.name)')} AS norm, count(DISTINCT m.chunk_id) AS n FROM {ent} e LEFT JOIN {men} m ON m.label = e.label AND m.name = e.name GROUP BY 1, 2, 3)
, {out} AS (SELECT label, name, canonical FROM (SELECT label, name, first_value(name) OVER (PARTITION BY label, norm ORDER BY n DESC, name DESC) AS canonical FROM {out}n) WHERE name <> canonical)"""


WENT = "wal AS (SELECT label, name, CAST([] AS VARCHAR[]) AS aliases FROM went)"
RESOLVED = f"{B.WRITTEN}, {WENT}, {SYN}{sql_renamed('wal', 'men', 'edg', 'm1', 'p')}{sql_normal('pent', 'pmen', 'm2')}, pali2 AS (SELECT label, name, coalesce(aliases, []) AS aliases FROM pent){sql_renamed('pali2', 'pmen', 'pedg', 'm2', 'q')}"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TRIVIAL = "(length(name) <= 1 OR regexp_full_match(name, '[0-9.]+'))"
IS_STOP = f"(len({sql_words('lower(name)')}) > 0 AND len(list_filter({sql_words('lower(name)')}, lambda w: w NOT IN ({STOP}))) = 0)"
PHRASE = "CASE rel_type " + " ".join(f"WHEN '{r}' THEN '{p}'" for r, p in PHRASES.items()) + " ELSE replace(lower(rel_type), '_', ' ') END"
USABLE = "(len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
VEC = f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM vectors WHERE {USABLE} ORDER BY key LIMIT 1)
, vs AS (SELECT key, any_value(CAST(embedding AS DOUBLE[])) AS e FROM vectors WHERE {USABLE} GROUP BY key)
, sim AS (SELECT key, (1 + list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))) / 2 AS score FROM vs, q)"""
REL = f"""rel AS (SELECT 'out' AS direction, rel_type, tgt_label AS other_label, tgt_name AS other_name, e.* EXCLUDE ({E5}) FROM sco e JOIN hub ON hub.i = 1 AND hub.label = src_label AND hub.name = src_name
  UNION SELECT 'in', rel_type, src_label, src_name, e.* EXCLUDE ({E5}) FROM sco e JOIN hub ON hub.i = 1 AND hub.label = tgt_label AND hub.name = tgt_name)"""
EVID = "ev AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS pos FROM chu WHERE text IS NOT NULL)"
SUB = f"""WITH {B.G}, {B.CHUNKS}, {EVID}
, r1 AS (SELECT pos, label, name, row_number() OVER (PARTITION BY pos ORDER BY label, name) AS j FROM men JOIN ev USING (chunk_id) WHERE pos <= 3)
, r2 AS (SELECT label, name, row_number() OVER (ORDER BY pos, label, name) AS i FROM r1 WHERE j <= 8)
, nodes AS (SELECT name, arg_min(label, i) AS label FROM r2 WHERE i <= 20 GROUP BY name)"""
HYBRID = f"""{VEC}, nr AS (SELECT key AS chunk_id, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM sim)
, kw AS (SELECT chunk_id, NULL AS score, 5 + row_number() OVER (ORDER BY chunk_id) AS rank FROM chu WHERE contains(lower(text), 'blinded'))
, b0 AS (SELECT * FROM nr WHERE rank <= 5 UNION ALL SELECT * FROM kw WHERE rank <= 10)
, base AS (SELECT chunk_id, score, row_number() OVER (ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rank) AS d FROM b0) WHERE d = 1)"""
EXPAND = """
, nm AS (SELECT * FROM (SELECT b.rank AS r1, label, name, row_number() OVER (PARTITION BY b.rank ORDER BY label, name) AS r2 FROM base b JOIN men USING (chunk_id) WHERE b.rank <= 3) WHERE r2 <= 3)
, bn AS (SELECT * FROM (SELECT name, chunk_id, row_number() OVER (PARTITION BY name ORDER BY chunk_id) AS j FROM (SELECT DISTINCT name, chunk_id FROM men WHERE name IN (SELECT name FROM nm))) WHERE j <= 3)
, mo AS (SELECT chunk_id, min({'a': r1, 'b': r2, 'c': chunk_id}) AS o FROM nm JOIN bn USING (name) WHERE chunk_id NOT IN (SELECT chunk_id FROM base) GROUP BY 1)
, al AS (SELECT * FROM base UNION ALL SELECT chunk_id, NULL, 10 + row_number() OVER (ORDER BY o) FROM mo)"""
HYBRID_OUT = "SELECT pos, chunk_id, paper_id, section, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY rank) AS pos FROM {}) JOIN chu USING (chunk_id) WHERE pos <= 10"
EXPL = "SELECT label, name FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name) AS i FROM entities WHERE {hit}) WHERE i <= {n}"


ALL_EDGES = """al AS (SELECT src_label AS a, src_name AS b, rel_type AS r, tgt_label AS c, tgt_name AS d FROM edg UNION ALL SELECT label, name, 'MENTIONED_IN', 'Chunk', chunk_id FROM men UNION ALL SELECT 'Chunk', chunk_id, 'FROM_PAPER', 'Paper', paper_id FROM chu JOIN pap USING (paper_id))
, un AS (SELECT a, b, c, d, min(r) AS r FROM (SELECT a, b, r, c, d FROM al UNION ALL SELECT c, d, r, a, b FROM al) GROUP BY 1, 2, 3, 4)"""


def sql_shortest_path(hops: int) -> str:
    """The best path to every node of each distance in turn, as far as the last entity."""
    levels = "".join(
        f"""
, l{i} AS (SELECT c AS label, d AS key, min({{'n': list_append(n, d), 'r': list_append(rs, r)}}) AS p FROM (SELECT label, key, p.n AS n, p.r AS rs FROM l{i - 1}) x JOIN un ON a = label AND b = key
   WHERE {" AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} s WHERE s.label = c AND s.key = d)" for j in range(i))} GROUP BY 1, 2)"""
        for i in range(1, hops + 1)
    )
    ends = " UNION ALL ".join(f"SELECT {i} AS i, l.p FROM l{i} l JOIN last ON last.label = l.label AND last.name = l.key" for i in range(1, hops + 1))
    return f"""WITH {B.G}, fst AS (SELECT label, name FROM men GROUP BY 1, 2 ORDER BY count(*), label, name LIMIT 1), last AS (SELECT label, name FROM men GROUP BY 1, 2 ORDER BY count(*), label DESC, name DESC LIMIT 1), {B.PAPERS}, {B.CHUNKS}, {ALL_EDGES}
, l0 AS (SELECT label, name AS key, {{'n': [name], 'r': CAST([] AS VARCHAR[])}} AS p FROM fst){levels}
SELECT p.n AS nodes, p.r AS rels FROM ({ends}) ORDER BY i LIMIT 1"""


def oracle_sql():
    g, ch = f"WITH {B.G}", B.CHUNKS
    lo, hi = sql_wilson("k", "n")
    return {
        "edge_confidence": f"{g}, {sql_scored()} SELECT {E5}, evidence_count, k, n, confidence_lower, confidence_upper FROM sco",
        "edge_confidence_wilson": f"{g}, {sql_scored()} SELECT {E5}, {lo} AS confidence_lower, {hi} AS confidence_upper FROM kn",
        "wilson_grid": f"WITH t AS (SELECT n, unnest(range(0, n + 1)) AS k FROM range(0, 201) r(n)), c AS (SELECT k, n, {sql_ci('k', 'n')} FROM t) SELECT k, n, confidence_lower AS lower, confidence_upper AS upper FROM c",
        "upsert_papers": f"WITH {B.PAPERS} SELECT paper_id, title, f.d AS doi, f.y AS year FROM pap",
        "upsert_chunks": "SELECT chunk_id, section, chunk_index, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1",
        "upsert_entities": f"""WITH {B.S}, e AS (SELECT span_id, CASE WHEN l IN {LABELS} THEN l ELSE 'Mechanism' END AS label, canonical_name AS name, text, umls_cui FROM (SELECT *, coalesce(label, raw_label) AS l FROM s) WHERE canonical_name IS NOT NULL)
            SELECT label, name, coalesce(array_to_string(list_sort(list(DISTINCT text) FILTER (WHERE text IS NOT NULL)), '|'), '') AS aliases, arg_max(umls_cui, span_id) FILTER (WHERE umls_cui IS NOT NULL) AS umls_cui FROM e GROUP BY 1, 2""",
        "upsert_entities_strict": f"""WITH {B.S}, e AS (SELECT span_id, CASE WHEN l IN {LABELS} THEN l ELSE 'Mechanism' END AS label, canonical_name AS name, text, umls_cui FROM (SELECT *, coalesce(label, raw_label) AS l FROM s) WHERE canonical_name IS NOT NULL)
            SELECT label, name, arg_max(coalesce(text, ''), span_id) AS aliases, arg_max(umls_cui, span_id) FILTER (WHERE umls_cui IS NOT NULL) AS umls_cui FROM e GROUP BY 1, 2""",
        "upsert_mentions": f"{g} SELECT * FROM men",
        "upsert_edges": f"{g} SELECT * FROM edg",
        "overwrite_confidence": f"{g}, {sql_scored()} SELECT {E5}, evidence_count, CASE WHEN evidence_count > 1 THEN confidence_lower END AS confidence_lower, CASE WHEN evidence_count > 1 THEN confidence_upper END AS confidence_upper FROM sco",
        "set_embedding": f"WITH {ch}, v AS (SELECT key, any_value(len(embedding)) AS n FROM vectors GROUP BY key) SELECT chunk_id, CAST(n AS INT) AS dim FROM chu LEFT JOIN v ON key = chunk_id",
        "resume_pending": f"{g}, {ch} SELECT chunk_id, paper_id FROM chu WHERE chunk_id NOT IN (SELECT chunk_id FROM men)",
        "resolve_synonyms": f"WITH {B.WRITTEN}, {SYN} SELECT * FROM m1",
        "resolve_normalized": f"WITH {B.WRITTEN}{sql_normal('went', 'men', 'm2')} SELECT * FROM m2",
        "resolved_edges": f"WITH {RESOLVED} SELECT {E5}, evidence_count, CAST(len(source_chunk_ids) AS INT) AS n_chunks FROM qedg",
        "resolved_mentions": f"WITH {RESOLVED} SELECT * FROM qmen",
        "resolved_entities": f"WITH {RESOLVED} SELECT label, name, coalesce(array_to_string(aliases, '|'), '') AS aliases FROM qent",
        "resolved_confidence": f"""WITH {RESOLVED}, ok AS (SELECT label, name FROM qent WHERE NOT {TRIVIAL} AND NOT {IS_STOP})
            , cm AS (SELECT qmen.* FROM qmen JOIN ok USING (label, name))
            , ce AS (SELECT q.* FROM qedg q JOIN ok a ON a.label = src_label AND a.name = src_name JOIN ok b ON b.label = tgt_label AND b.name = tgt_name WHERE NOT (src_label = tgt_label AND src_name = tgt_name))
            , {sql_scored('ce', 'cm')} SELECT {E5}, k, n, confidence_lower, confidence_upper FROM sco""",
        "clean_isolated": f"WITH {B.NOISY} SELECT label, name FROM nent JOIN ends USING (label, name)",
        "clean_trivial": f"WITH {B.NOISY} SELECT * FROM nmen WHERE NOT {TRIVIAL}",
        "clean_stopwords": f"WITH {B.NOISY} SELECT label, name FROM nent WHERE NOT {IS_STOP}",
        "clean_self_loops": f"{g} SELECT {E5}, evidence_count FROM edg WHERE NOT (src_label = tgt_label AND src_name = tgt_name)",
        "clean_stats": f"""WITH {B.NOISY}, one AS (SELECT label, name FROM nent JOIN ends USING (label, name))
            SELECT (SELECT count(*) FROM nent) - (SELECT count(*) FROM one) AS isolated_nodes, (SELECT count(*) FROM one WHERE {TRIVIAL}) AS trivial_name_nodes,
                   (SELECT count(*) FROM one WHERE NOT {TRIVIAL} AND {IS_STOP}) AS stopword_nodes, (SELECT count(*) FROM edg WHERE src_label = tgt_label AND src_name = tgt_name) AS self_loops""",
        "node_texts": f"""{g}, o AS (SELECT src_label AS label, src_name AS name, 0 AS d, row_number() OVER (PARTITION BY src_label, src_name ORDER BY evidence_count DESC, rel_type, tgt_name, tgt_label) AS i, {PHRASE} || ' ' || tgt_name || ' (' || tgt_label || ')' AS t FROM edg
              UNION ALL SELECT tgt_label, tgt_name, 1, row_number() OVER (PARTITION BY tgt_label, tgt_name ORDER BY evidence_count DESC, rel_type, src_name, src_label), src_name || ' (' || src_label || ') ' || {PHRASE} || ' this' FROM edg)
            , c AS (SELECT label, name, string_agg(t, '. ' ORDER BY d, i) || '.' AS c FROM o WHERE i <= 5 GROUP BY 1, 2)
            SELECT label, name AS key, CASE label WHEN 'Pathway' THEN 'Biological pathway' WHEN 'CellType' THEN 'Cell type' WHEN 'Mechanism' THEN 'Biological mechanism' ELSE label END || ' ' || name || '. Also known as: '
              || CASE WHEN len(aliases) > 0 THEN array_to_string(aliases[:5], ', ') ELSE 'none' END || '. ' || coalesce(c, 'No known relationships in graph.') AS text FROM entities LEFT JOIN c USING (label, name)""",
        "chunk_texts": f"WITH {ch} SELECT 'Chunk' AS label, chunk_id AS key, coalesce(section, '') || ' (from paper ' || coalesce(paper_id, '') || '): ' || coalesce(text, '')[:1800] AS text FROM chu",
        "knn_vectors": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, (1 + list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))) / 2 AS score FROM e, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10",
        "knn_label": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 3), s AS (SELECT vec_id, (1 + list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))) / 2 AS score FROM e, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10",
        "run_query": f"{g} SELECT rel_type, tgt_label, count(*) AS n, CAST(sum(evidence_count) AS BIGINT) AS evidence FROM edg WHERE src_label = 'Gene' AND evidence_count >= 2 GROUP BY 1, 2",
        "vector_index_search": f"WITH {VEC} SELECT key, round(score, 6) AS score FROM (SELECT * FROM sim ORDER BY score DESC, key LIMIT 10)",
        "knn_chunks": f"WITH {VEC} SELECT key, round(score, 6) AS score FROM (SELECT * FROM sim ORDER BY score DESC, key LIMIT 10)",
        "rank_papers": f"WITH {ch}, {VEC}, t AS (SELECT paper_id, score FROM sim JOIN chu ON chunk_id = key ORDER BY score DESC, key LIMIT 15), p AS (SELECT paper_id, max(score) AS m FROM t GROUP BY 1 ORDER BY m DESC, paper_id LIMIT 5) SELECT paper_id, round(m, 6) AS score FROM p",
        "entity_relationships": f"{g}, {B.HUB}, sco AS (SELECT {E5}, evidence_count, CAST(NULL AS DOUBLE) AS confidence_lower, CAST(NULL AS DOUBLE) AS confidence_upper FROM edg), {REL} SELECT * FROM rel",
        "entity_relationships_strict": f"""{g}, {B.HUB} SELECT DISTINCT 'out' AS direction, rel_type, unnest([tgt_label, src_label]) AS other_label, unnest([tgt_name, src_name]) AS other_name, evidence_count, CAST(NULL AS DOUBLE) AS confidence_lower, CAST(NULL AS DOUBLE) AS confidence_upper
            FROM edg JOIN hub ON hub.i = 1 AND hub.label = src_label AND hub.name = src_name""",
        "edge_lookup": f"""{g}, {B.HUB}, {sql_scored()}, one AS (SELECT 1 AS o), f AS (SELECT 1 AS o, confidence_lower, confidence_upper, evidence_count FROM sco JOIN hub a ON a.i = 1 AND a.label = src_label AND a.name = src_name JOIN hub b ON b.i = 2 AND b.label = tgt_label AND b.name = tgt_name WHERE rel_type = 'ASSOCIATED_WITH')
            SELECT confidence_lower AS lower, confidence_upper AS upper, coalesce(evidence_count, 0) AS evidence_count FROM one LEFT JOIN f USING (o)""",
        "chunk_lookup": f"WITH {ch}, {EVID} SELECT text FROM chu JOIN ev USING (chunk_id) WHERE pos = 1 UNION ALL SELECT 'Chunk not found'",
        "search_entity": "SELECT label, name, coalesce(array_to_string(aliases, '|'), '-') AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY name) AS i FROM entities WHERE contains(lower(name), 'an') OR len(list_filter(coalesce(aliases, []), lambda a: contains(lower(a), 'an'))) > 0) WHERE i <= 10",
        "keyword_chunks": f"WITH {ch} SELECT chunk_id, paper_id, section, text FROM chu WHERE contains(lower(text), 'blinded') ORDER BY chunk_id LIMIT 10",
        "hybrid_search": f"WITH {ch}, {HYBRID} {HYBRID_OUT.format('base')}",
        "hybrid_search_expand": f"{g}, {ch}, {HYBRID}{EXPAND} {HYBRID_OUT.format('al')}",
        "hop_distances": f"""WITH RECURSIVE {B.G}, {B.HUB}, {B.PAPERS}, {ch}, al AS (SELECT src_label AS a, src_name AS b, tgt_label AS c, tgt_name AS d FROM edg UNION SELECT label, name, 'Chunk', chunk_id FROM men UNION SELECT 'Chunk', chunk_id, 'Paper', paper_id FROM chu JOIN pap USING (paper_id))
            , un AS (SELECT a, b, c, d FROM al UNION SELECT c, d, a, b FROM al)
            , bf AS (SELECT label, name AS key, 0 AS hops FROM hub WHERE i = 1 UNION SELECT c, d, hops + 1 FROM bf JOIN un ON a = label AND b = key WHERE hops < 3)
            SELECT label, key, CAST(min(hops) AS INT) AS hops FROM bf GROUP BY 1, 2""",
        "shortest_path": sql_shortest_path(4),
        "graph_stats_nodes": f"WITH {B.PAPERS}, {ch}, n AS (SELECT 'Paper' AS label, count(*) AS n FROM pap UNION ALL SELECT 'Chunk', count(*) FROM chu UNION ALL SELECT label, count(*) FROM entities GROUP BY 1) SELECT l AS label, coalesce(n, 0) AS n FROM (SELECT unnest(['Paper', 'Chunk', {', '.join(repr(x) for x in LABELS)}]) AS l) LEFT JOIN n ON label = l",
        "graph_stats_edges": f"{g}, {B.PAPERS}, {ch} SELECT rel_type, count(*) AS n FROM edg GROUP BY 1 UNION ALL SELECT 'MENTIONED_IN', count(*) FROM men UNION ALL SELECT 'FROM_PAPER', count(*) FROM chu JOIN pap USING (paper_id)",
        "sidebar_totals": f"WITH {B.PAPERS}, {ch} SELECT (SELECT count(*) FROM pap) AS papers, (SELECT count(*) FROM chu) AS chunks, (SELECT count(*) FROM entities) AS entities",
        "explorer_search": EXPL.format(hit="contains(lower(name), 'an')", n=5),
        "explorer_table": f"{g}, {B.HUB}, {sql_scored()}, {REL} SELECT direction, rel_type, other_label, other_name, evidence_count, printf('[%.2f, %.2f]', confidence_lower, confidence_upper) AS interval FROM rel",
        "paper_list": f"WITH {B.PAPERS} SELECT paper_id, title FROM pap",
        "chunk_browser": f"WITH {B.PAPERS}, {ch} SELECT chunk_id, section, chunk_index, text FROM chu WHERE paper_id = (SELECT min(paper_id) FROM pap)",
        "chunk_entities": f"{g}, {ch}, {EVID} SELECT label, name, count FROM men JOIN ev USING (chunk_id) WHERE pos = 1",
        "subgraph_nodes": f"{SUB} SELECT name, label FROM nodes",
        "subgraph_edges": f"""{SUB}, i AS (SELECT least(src_name, tgt_name) AS a, greatest(src_name, tgt_name) AS b, min({{'s': src_name, 'r': rel_type, 't': tgt_name}}) AS e FROM edg WHERE src_name <> tgt_name AND src_name IN (SELECT name FROM nodes) AND tgt_name IN (SELECT name FROM nodes) GROUP BY 1, 2)
            SELECT e.s AS src_name, e.r AS rel_type, e.t AS tgt_name FROM i""",
        "evidence_passages": f"WITH {ch}, {EVID} SELECT CAST(pos AS INT) AS pos, chunk_id, text[:500] AS passage FROM chu JOIN ev USING (chunk_id) WHERE pos <= 6",
    }
