"""Answering questions with tools over a graph: specifications, dispatch, the loop, and calibration."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import EngineConfig
from graphloom.functions import stats
from graphloom.graph import KnowledgeGraph
from graphloom.operators import paths, retrieve
from graphloom.operators.embed import Embedder, HashedWords


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    required: dict[str, str]
    optional: dict[str, object] = field(default_factory=dict)

    def schema(self) -> dict:
        """The tool as a JSON Schema object."""
        kinds = {str: "string", int: "integer", bool: "boolean"}
        properties = {n: {"type": t} for n, t in self.required.items()} | {n: {"type": kinds[type(d)], "default": d} for n, d in self.optional.items()}
        return {"name": self.name, "description": self.about, "input_schema": {"type": "object", "properties": properties, "required": list(self.required)}}


#: Relationships in one answer of the tool; the pages follow each other in a total order.
PAGE = 100

TOOLS = (
    Tool("rank_papers", "Papers by their best chunk for a query.", {"query": "string"}, {"top_k": 5}),
    Tool("search_entity", "Entities whose name or alias holds a text.", {"name": "string"}, {"entity_type": "Any"}),
    Tool("get_entity_relationships", f"Edges out of and into an entity, those of most evidence first; {PAGE} a page from page 0 on, and after a full page there may be another.", {"entity_type": "string", "entity_name": "string"}, {"page": 0}),
    Tool("search_chunks", "Chunks near a query or holding it, with those of their entities if asked.", {"query": "string"}, {"top_k": 5, "expand_graph": False}),
    Tool("get_chunk_text", "The text of a chunk.", {"chunk_id": "string"}),
    Tool("find_path", "A shortest path between two entities.", {"source_type": "string", "source_name": "string", "target_type": "string", "target_name": "string"}, {"max_hops": 4}),
    Tool("get_edge_confidence", "Interval and evidence of an edge.", {"source_type": "string", "source_name": "string", "relationship": "string", "target_type": "string", "target_name": "string"}),
)


@dataclass
class Toolbox:
    """The tools over one graph; ``vectors (key, embedding)`` are those of its chunks."""

    graph: KnowledgeGraph
    vectors: DataFrame
    embedder: Embedder = field(default_factory=HashedWords)

    @cached_property
    def steps(self) -> DataFrame:
        """The graph's adjacency, made with the first path that is asked for."""
        return paths.adjacency(self.graph.all_edges())

    def execute(self, name: str, inputs: dict) -> DataFrame:
        tool = next((t for t in TOOLS if t.name == name), None)
        if tool is None:
            return self.graph.papers.sparkSession.createDataFrame([(f"Unknown tool: {name}",)], "error string")
        x = {**tool.optional, **inputs}
        g = self.graph
        if name == "rank_papers":
            joined = g.chunks.join(self.vectors.select(F.col("key").alias("chunk_id"), "embedding"), "chunk_id")
            return retrieve.rank_papers(joined, self._vector(x["query"]), x["top_k"])
        if name == "search_entity":
            return retrieve.search_entity(g.entities, x["name"], x["entity_type"])
        if name == "get_entity_relationships":
            edges = retrieve.relationships(g, x["entity_type"], x["entity_name"])
            order = [F.desc("evidence_count"), "other_name", "other_label", "rel_type", "direction", "confidence_lower", "confidence_upper"]
            return edges.orderBy(*order).offset(max(0, x["page"]) * PAGE).limit(PAGE)
        if name == "search_chunks":
            return retrieve.hybrid_search(g, self.vectors, self._vector(x["query"]), x["query"], x["top_k"], x["expand_graph"])
        if name == "get_chunk_text":
            return retrieve.chunk_lookup(g.chunks, x["chunk_id"])
        if name == "find_path":
            return paths.shortest_path(g.all_edges(), (x["source_type"], x["source_name"]), (x["target_type"], x["target_name"]), x["max_hops"], steps=self.steps)
        return retrieve.edge_lookup(g, (x["source_type"], x["source_name"]), x["relationship"], (x["target_type"], x["target_name"]))

    def _vector(self, query: str) -> list[float]:
        return self.embedder([query])[0]


#: A planner takes the question and the trace so far and gives the next calls, or an answer.
Planner = Callable[[str, list[dict]], "list[tuple[str, dict]] | str"]


def offline_planner(question: str, trace: list[dict]) -> list[tuple[str, dict]] | str:
    """Look the words of the question up, read the chunks found, and quote them."""
    if not trace:
        words = sorted({w.strip("?.,;:!()\"'") for w in question.split()}, key=lambda w: (-len(w), w))
        return [("search_chunks", {"query": question, "expand_graph": True})] + [("search_entity", {"name": w}) for w in words[:2] if len(w) > 3]
    found = [r for t in trace for r in t["output"] if r.get("chunk_id")]
    names = sorted({r["name"] for t in trace if t["tool"] == "search_entity" for r in t["output"]})[:5]
    quotes = " ".join((r.get("text") or "").split(". ")[0].strip() + "." for r in found[:3])
    return f"Entities: {', '.join(names) or 'none'}. {quotes}".strip()


def calibration_prompt(question: str, answer: str, sources: list[str], config: EngineConfig = EngineConfig()) -> str:
    """The message to a calibrator: at most a few sources, each cut."""
    blocks = "\n\n".join(f"[Source {i}]\n{text[: config.source_chars]}" for i, text in enumerate(sources[: config.sources_shown], 1))
    return f"Question: {question}\n\nAnswer: {answer}\n\nSources:\n{blocks}"


def offline_calibrator(prompt: str) -> dict:
    """Confidence from the share of the prompt's sources that hold a longer word of its question."""
    head, _, rest = prompt.partition("\n\nSources:\n")
    question = head.partition("\n\nAnswer: ")[0].removeprefix("Question: ")
    sources = re.split(r"(?:\A|\n\n)\[Source \d+\]\n", rest)[1:]
    words = {w.strip("?.,;:!()\"'").lower() for w in question.split() if len(w) > 4}
    n, k = len(sources), sum(any(w in (s or "").lower() for w in words) for s in sources)
    score = round(100 * k / n) if n else 0
    return {"score": float(score), "label": "High" if score >= 80 else "Medium" if score >= 50 else "Low", "lower_bound": max(0.0, score / 100 - 0.2), "upper_bound": min(1.0, score / 100 + 0.2), "rationale": f"{k} of {n} sources name what is asked.", "evidence_count": k, "contradictions": "none"}


RECORD = "score double, label string, lower_bound double, upper_bound double, rationale string, evidence_count int, contradictions string"


#: A calibrator takes the prompt and gives the fields of RECORD; one that raises hands over to the next.
Calibrator = Callable[[str], dict]


def ask(question: str, toolbox: Toolbox, planner: Planner = offline_planner, calibrators: list[Calibrator] | None = None, config: EngineConfig = EngineConfig()) -> tuple[str, list[str], dict, list[dict]]:
    """``(answer, evidence chunk ids, confidence, trace)``; the tools' results are top-k lists or pages, so the trace is small."""
    trace: list[dict] = []
    evidence: list[str] = []
    answer = ""
    for _ in range(config.max_turns):
        step = planner(question, trace)
        if isinstance(step, str):
            answer = step
            break
        for name, inputs in step:
            output = [r.asDict() for r in toolbox.execute(name, inputs).collect()]
            trace.append({"tool": name, "input": inputs, "output": output})
            evidence += [r["chunk_id"] for r in output if "__" in str(r.get("chunk_id", "")) and r["chunk_id"] not in evidence]
    spark = toolbox.graph.chunks.sparkSession
    ids = spark.createDataFrame(list(enumerate(dict.fromkeys(evidence[: config.sources_shown]))), "pos int, chunk_id string")
    sources = [r["text"] or "" for r in retrieve.texts_in_order(toolbox.graph.chunks, F.broadcast(ids)).collect()]
    raw: dict = {}
    prompt = calibration_prompt(question, answer, sources, config)
    for calibrate in calibrators or [offline_calibrator]:
        try:
            raw = calibrate(prompt)
            break
        except Exception:  # noqa: BLE001, S112 - any failure hands over to the next
            continue
    frame = spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.from_json("j", RECORD).alias("r"))
    record = frame.select(stats.confidence_record(F.col("r")).alias("c")).first()["c"].asDict()
    return answer, list(dict.fromkeys(evidence)), record, trace
