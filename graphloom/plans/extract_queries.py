"""Queries over recognised spans, extractor answers, confidence records, offline seams, and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import agent
from graphloom.config import LABELS, RECOGNISED_LABELS, RELATIONS
from graphloom.functions import stats
from graphloom.operators import embed, extract, recognize, retrieve
from graphloom.pipeline import Pipeline
from graphloom.plans import binding as B
from graphloom.plans.graph_queries import sql_ci
from graphloom.plans.text_queries import sql_strip
from graphloom.sources.tables import table
from graphloom.streaming.incremental import windowed_activity


def ner_label_map(s, d):
    spans = B.spans(s, d)
    return spans.select("span_id", "raw_label", recognize.mapped_label(F.col("raw_label")).alias("mapped"))


def ner_hints(s, d):
    return recognize.prompt_hints(B.chunks(s, d), B.spans(s, d))


def ner_span_merge(s, d):
    spans = B.spans(s, d)
    second = F.col("raw_label").isin("DISEASE", "CHEMICAL")
    first = spans.where(~F.coalesce(second, F.lit(False)))
    return recognize.merged_passes(first, spans.where(second)).select("span_id", "pass")


def cache_key_lookup(s, d):
    """A cache of all chunks with even numbers, every fourth of which has changed since."""
    chunks = B.chunks(s, d)
    was = F.when(F.col("chunk_index") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    cache = chunks.where("chunk_index % 2 = 0 AND text IS NOT NULL").select("paper_id", "chunk_index", extract.cache_key(was).alias("text_key"), F.lit("{}").alias("raw"))
    hits, misses = extract.cached(chunks, cache)
    return hits.select("chunk_id", "text_key", F.lit(True).alias("hit")).unionByName(misses.select("chunk_id", "text_key", F.lit(False).alias("hit")))


def _answers(s, d):
    """Answers as an extractor might give them: the spans of a chunk, fenced in every second chunk."""
    spans = B.spans(s, d)
    item = F.struct("span_id", F.struct(F.concat(F.lit(" "), "text").alias("name"), F.col("label").alias("type"), F.array("canonical_name").alias("aliases")).alias("e"))
    edge = F.struct(
        "seq",
        F.struct(
            F.col("src_name").alias("source_name"), F.col("src_label").alias("source_type"), F.lower("rel_type").alias("relationship"),
            F.col("tgt_name").alias("target_name"), F.when(F.col("tgt_label") != "Drug", F.col("tgt_label")).otherwise(F.lit("Molecule")).alias("target_type"), F.repeat("src_name", 20).alias("evidence"),
        ).alias("r"),
    )
    ent = spans.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    rel = B.assertions(spans.where("label IS NOT NULL AND text IS NOT NULL"), "text").groupBy("chunk_id").agg(F.array_sort(F.collect_list(edge)).alias("r"))
    body = F.to_json(F.struct(F.transform("e", lambda x: x["e"]).alias("entities"), F.transform("r", lambda x: x["r"]).alias("relationships")))
    odd = F.pmod(F.length("chunk_id"), F.lit(2)) == 1
    raw = F.when(odd, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return ent.join(rel, "chunk_id", "left").select("chunk_id", raw.alias("raw"))


def json_entities(s, d):
    found = extract.valid_entities(_answers(s, d))
    return found.select("chunk_id", "i", "name", "type", F.array_join("aliases", "|").alias("aliases"))


def json_relations(s, d):
    return extract.valid_relationships(_answers(s, d)).drop("i")


def json_tolerance(s, d):
    """Odd answers: fences, garbage, other things than objects, missing, wrong and mistyped fields."""
    rows = [
        (1, '{"entities":[{"name":"a","type":"Gene","aliases":["x",1,null]},"no",{"name":"b"},{"name":"c","type":"Planet"},{"name":" ","type":"Gene"},{"name":null}]}'),
        (2, 'Sure:\n```json\n{"entities":[{"name":" d ","type":"Drug"}]}\n```'),
        (3, "nothing"),
        (4, "[1, 2]"),
        (5, '{"entities":{"name":"e"}}'),
        (6, "{broken} {"),
        (7, None),
        (8, ""),
    ]
    return extract.valid_entities(s.createDataFrame(rows, "id int, raw string")).select("id", "i", "name", "type", F.array_join("aliases", "|").alias("aliases"))


def logprob_ci(s, d):
    vectors = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("p"))
    ci = stats.logprob_interval(F.slice("p", 1, F.pmod("vec_id", F.lit(60)).cast("int")))
    return vectors.select("vec_id", ci.alias("c")).select("vec_id", "c.lower", "c.upper")


def _records(s, d):
    e = table(s, d, "events")
    raw = F.struct(
        F.when(F.col("event_id") % 7 != 0, F.col("value") * 1.5 - 20).alias("score"),
        F.when(F.col("event_id") % 4 == 0, "High").when(F.col("event_id") % 4 == 1, "Low").when(F.col("event_id") % 4 == 2, "Sure").alias("label"),
        (F.col("value") / 50).alias("lower_bound"),
        (1 - F.col("value") / 80).alias("upper_bound"),
        F.col("event_type").alias("rationale"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("int")).alias("evidence_count"),
        F.when(F.col("event_id") % 5 == 0, "None").when(F.col("event_id") % 5 == 1, "one source disagrees").alias("contradictions"),
    )
    return e.select("event_id", stats.confidence_record(raw).alias("c"))


def validate_confidence(s, d):
    return _records(s, d).select("event_id", "c.*")


def confidence_badge(s, d):
    return _records(s, d).select("event_id", stats.badge(F.col("c")).alias("b")).select("event_id", "b.colour", "b.fraction", "b.contradictions")


def prompts(s, d):
    chunks = B.chunks(s, d).where("text IS NOT NULL")
    hinted = chunks.join(recognize.prompt_hints(chunks, B.spans(s, d)), "chunk_id")
    return hinted.select("chunk_id", F.sha2(extract.prompt(F.col("hints"), F.col("text")), 256).alias("digest"))


def hash_embed(s, d):
    texts = embed.chunk_texts(B.chunks(s, d))
    return embed.embed(texts).select("label", "key", "embedding")


def pipeline_build(s, d):
    """Documents to a refined graph with the offline recogniser and extractor; its edges."""
    documents = table(s, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("paper_id"), "text")
    names = [(r["name"], r["label"]) for r in table(s, d, "entities").select("name", "label").collect()]  # a fixed list of 1,400
    made = Pipeline(recognize.Gazetteer(names))
    papers = documents.select("paper_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"))
    return made.refined(made.build(documents, papers), table(s, d, "synonyms")).edges


def pipeline_fixture(s, d):
    """A small text through the whole pipeline; the edges of the refined graph."""
    documents = s.createDataFrame([("d1", "# T\n\n## A\nAlpha binds beta. Alpha meets gamma and beta.\n## B\nOnly gamma."), ("d2", "Alpha binds beta. Beta binds gamma."), ("d3", None)], "paper_id string, text string")
    papers = documents.select("paper_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("int").alias("year"))
    made = Pipeline(recognize.Gazetteer([("alpha", "Gene"), ("beta", "DISEASE"), ("gamma", "Planet")]))
    synonyms = s.createDataFrame([("gamma", "Gamma thing")], "alias string, canonical string")
    return made.refined(made.build(documents, papers), synonyms).edges


def evidence_ids(s, d):
    """Ids of chunks in a trace of tool results, each at its first place."""
    rows = [(2, 0, "p__0001"), (1, 0, "p__0002"), (1, 1, "no chunk"), (3, 0, "p__0002"), (1, 2, None), (3, 1, "q__0000"), (2, 1, "p__0001")]
    return retrieve.evidence_ids(s.createDataFrame(rows, "seq int, pos int, id string"))


def answer_offline(s, d):
    """The offline agent's answer to a question about the commonest entity."""
    g = B.staged_graph(s, d)
    name = B.hubs(g, 1)[0][1]
    vectors = embed.embed(embed.chunk_texts(g.chunks)).select("key", "embedding")
    answer, evidence, record, trace = agent.ask(f"What is known about {name}?", agent.Toolbox(g, vectors))
    return s.createDataFrame([(answer, evidence, record["score"], record["label"], len(trace))], "answer string, evidence array<string>, score int, label string, calls int")




def event_windows(s, d):
    return windowed_activity(table(s, d, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def queries():
    return {
        "ner_label_map": ner_label_map,
        "ner_hints": ner_hints,
        "ner_span_merge": ner_span_merge,
        "cache_key_lookup": cache_key_lookup,
        "json_entities": json_entities,
        "json_relations": json_relations,
        "json_tolerance": json_tolerance,
        "prompts": prompts,
        "logprob_ci": logprob_ci,
        "validate_confidence": validate_confidence,
        "confidence_badge": confidence_badge,
        "hash_embed": hash_embed,
        "pipeline_build": pipeline_build,
        "pipeline_fixture": pipeline_fixture,
        "evidence_ids": evidence_ids,
        "answer_offline": answer_offline,
        "event_windows": event_windows,
    }


MAPPED = "CASE raw_label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RECOGNISED_LABELS.items()) + " ELSE raw_label END"
HINTS = f"""WITH {B.S}, {B.CHUNKS}, l AS (SELECT chunk_id, string_agg('  - ' || coalesce(text, '') || ' (' || coalesce(label, '') || ')' || CASE WHEN coalesce(canonical_name, '') <> '' THEN ' → ' || canonical_name ELSE '' END
   || CASE WHEN coalesce(umls_cui, '') <> '' THEN ' [UMLS:' || umls_cui || ']' ELSE '' END, chr(10) ORDER BY start_char, span_id) AS h FROM s GROUP BY 1)
, hin AS (SELECT chunk_id, text, coalesce(h, '(none detected)') AS hints FROM chu LEFT JOIN l USING (chunk_id))"""
CONF = """WITH r AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value * 1.5 - 20 ELSE 50 END AS sc, CASE WHEN event_id % 4 = 0 THEN 'High' WHEN event_id % 4 = 1 THEN 'Low' ELSE 'Medium' END AS label,
  greatest(0.0, least(1.0, value / 50)) AS lo, greatest(0.0, least(1.0, 1 - value / 80)) AS hi, event_type AS rationale, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS INT) ELSE 0 END AS evidence_count,
  CASE WHEN event_id % 5 = 0 THEN 'None' WHEN event_id % 5 = 1 THEN 'one source disagrees' ELSE 'none' END AS contradictions FROM events)
, c AS (SELECT *, greatest(0, least(100, CAST(trunc(sc) AS INT))) AS score FROM r)"""


def oracle_sql():
    labels, relations = ", ".join(f"'{x}'" for x in LABELS), ", ".join(f"'{x}'" for x in RELATIONS)
    name = sql_strip("text")
    known = lambda c: f"CASE WHEN {c} IN ({labels}) THEN {c} ELSE 'Mechanism' END"
    return {
        "ner_label_map": f"WITH {B.S} SELECT span_id, raw_label, {MAPPED} AS mapped FROM s",
        "ner_hints": f"{HINTS} SELECT chunk_id, hints FROM hin",
        "ner_span_merge": f"""WITH {B.S}, f AS (SELECT * FROM s WHERE coalesce(raw_label, '') NOT IN ('DISEASE', 'CHEMICAL'))
            SELECT span_id, 1 AS pass FROM f UNION ALL SELECT span_id, 2 FROM s WHERE raw_label IN ('DISEASE', 'CHEMICAL') AND NOT EXISTS (SELECT 1 FROM f WHERE f.chunk_id = s.chunk_id AND f.start_char = s.start_char AND f.end_char = s.end_char)""",
        "cache_key_lookup": f"WITH {B.CHUNKS} SELECT chunk_id, sha256(text)[:12] AS text_key, coalesce(text IS NOT NULL AND chunk_index % 2 = 0 AND chunk_index % 4 <> 0, false) AS hit FROM chu",
        "json_entities": f"""WITH {B.S}, e AS (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY span_id) - 1 AS INT) AS i, {name} AS name, coalesce(label, 'Mechanism') AS type, coalesce(canonical_name, '') AS aliases FROM s)
            SELECT * FROM e WHERE name <> '' AND type IN ({labels})""",
        "json_relations": f"""WITH {B.WRITTEN}, r AS (SELECT chunk_id, {sql_strip('src_name')} AS source_name, {known('src_label')} AS source_type, upper(r) AS relationship, {sql_strip('tgt_name')} AS target_name,
              CASE WHEN tgt_label = 'Drug' THEN 'Mechanism' ELSE {known('tgt_label')} END AS target_type, repeat(src_name, 20)[:300] AS evidence FROM (SELECT *, {B.RELATION} AS r FROM asr))
            SELECT * FROM r WHERE source_name <> '' AND target_name <> '' AND relationship IN ({relations})""",
        "json_tolerance": "SELECT * FROM (VALUES (1, 0, 'a', 'Gene', 'x'), (1, 2, 'b', 'Mechanism', ''), (2, 0, 'd', 'Drug', '')) t(id, i, name, type, aliases)",
        "prompts": f"{HINTS} SELECT chunk_id, sha256('Recognised spans:' || chr(10) || hints || chr(10) || chr(10) || 'Passage:' || chr(10) || text) AS digest FROM hin WHERE text IS NOT NULL",
        "logprob_ci": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)))[:vec_id % 60] AS p FROM embeddings), m AS (SELECT vec_id, len(p) AS n, least(greatest(exp(list_sum(p) / len(p)), 1e-6), 1 - 1e-6) AS p FROM v)
            , k AS (SELECT vec_id, n, CASE WHEN n > 0 THEN CAST(round_even(p * n, 0) AS BIGINT) ELSE 0 END AS k FROM m), c AS (SELECT vec_id, {sql_ci('k', 'n')} FROM k) SELECT vec_id, confidence_lower AS lower, confidence_upper AS upper FROM c""",
        "validate_confidence": f"{CONF} SELECT event_id, score, label, least(lo, hi) AS lower_bound, greatest(lo, hi) AS upper_bound, rationale, evidence_count, contradictions FROM c",
        "confidence_badge": f"{CONF} SELECT event_id, CASE label WHEN 'High' THEN 'green' WHEN 'Low' THEN 'red' ELSE 'orange' END AS colour, score / 100.0 AS fraction, CASE WHEN lower(contradictions) <> 'none' THEN contradictions END AS contradictions FROM c",
        "pipeline_fixture": """SELECT * FROM (VALUES ('Gene', 'Alpha', 'ASSOCIATED_WITH', 'Disease', 'beta', CAST(2 AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE),
              ('Mechanism', 'Gamma thing', 'ASSOCIATED_WITH', 'Disease', 'beta', 1, 1.0, 1.0), ('Disease', 'beta', 'ASSOCIATED_WITH', 'Mechanism', 'Gamma thing', 1, 1.0, 1.0))
            t(src_label, src_name, rel_type, tgt_label, tgt_name, evidence_count, confidence_lower, confidence_upper)""",
        "evidence_ids": "SELECT * FROM (VALUES (1, 'p__0002'), (2, 'p__0001'), (3, 'q__0000')) t(pos, chunk_id)",
        "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    }
