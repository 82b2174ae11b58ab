"""Vocabularies and constants of the engine; all of them are parameters with these defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# fixed values: labels of entities, types of relations, and the two structural edge types
LABELS = ("Gene", "Protein", "Drug", "Disease", "Pathway", "CellType", "Organism", "Mechanism")
RELATIONS = ("REGULATES", "INHIBITS", "ACTIVATES", "TARGETS", "BINDS", "ASSOCIATED_WITH", "PROMOTES", "SUPPRESSES", "INVOLVES", "EXPRESSED_IN", "MUTATED_IN")
STRUCTURAL = ("MENTIONED_IN", "FROM_PAPER")
FALLBACK_LABEL, FALLBACK_RELATION = "Mechanism", "ASSOCIATED_WITH"

# fixed values: how edge types read in a sentence
PHRASES = {
    "REGULATES": "regulates",
    "INHIBITS": "inhibits",
    "ACTIVATES": "activates",
    "TARGETS": "targets",
    "BINDS": "binds to",
    "ASSOCIATED_WITH": "is associated with",
    "PROMOTES": "promotes",
    "SUPPRESSES": "suppresses",
    "INVOLVES": "involves",
    "EXPRESSED_IN": "is expressed in",
    "MUTATED_IN": "is mutated in",
    "MENTIONED_IN": "mentioned in",
    "FROM_PAPER": "from paper",
}

# fixed values: how a label reads at the head of a node's text
LABEL_PHRASES = {"Pathway": "Biological pathway", "CellType": "Cell type", "Mechanism": "Biological mechanism"}

# fixed values: recognisers' labels and ours; others stand for themselves
RECOGNISED_LABELS = {
    "GENE_OR_GENE_PRODUCT": "Gene",
    "SIMPLE_CHEMICAL": "Drug",
    "DISEASE_OR_PHENOTYPIC_FEATURE": "Disease",
    "CELL": "CellType",
    "ORGANISM": "Organism",
    "CELLULAR_COMPONENT": "Mechanism",
    "MOLECULAR_FUNCTION": "Mechanism",
    "BIOLOGICAL_PROCESS": "Pathway",
    "CANCER": "Disease",
    "CHEMICAL": "Drug",
    "DISEASE": "Disease",
}

# fixed values: words that make no name by themselves
STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "and", "or", "but",
    "for", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "this", "that", "these", "those", "it", "its", "we", "our", "they",
    "not", "also", "such", "both", "all", "many", "some", "than", "more",
    "most", "well", "only", "other", "further", "however", "therefore",
    "figure", "table", "fig", "et", "al", "supplementary", "data",
)


#: Names in general use for one thing, by their usual spelling; a table of one's own takes its place.
SYNONYMS = {
    "p53": "TP53",
    "her2": "ERBB2",
    "her2/neu": "ERBB2",
    "c-myc": "MYC",
    "pd-1": "PDCD1",
    "pd-l1": "CD274",
    "vegf": "VEGFA",
    "tnf-alpha": "TNF",
    "tnf-α": "TNF",
    "tumor necrosis factor": "TNF",
    "il-6": "IL6",
    "interleukin-6": "IL6",
    "il-1β": "IL1B",
    "tgf-β": "TGFB1",
    "tgf-beta": "TGFB1",
    "ifn-γ": "IFNG",
    "nf-κb": "NF-kB",
    "nf-kappab": "NF-kB",
    "acetylsalicylic acid": "aspirin",
    "paracetamol": "acetaminophen",
    "5-fu": "fluorouracil",
    "5-fluorouracil": "fluorouracil",
    "adriamycin": "doxorubicin",
    "type ii diabetes": "type 2 diabetes",
    "t2d": "type 2 diabetes",
    "t2dm": "type 2 diabetes",
    "heart attack": "myocardial infarction",
    "high blood pressure": "hypertension",
    "stroke": "cerebrovascular accident",
    "copd": "chronic obstructive pulmonary disease",
    "nsclc": "non-small cell lung cancer",
    "hcc": "hepatocellular carcinoma",
    "aml": "acute myeloid leukemia",
    "natural killer cell": "NK cell",
    "treg": "regulatory T cell",
    "tregs": "regulatory T cell",
    "e. coli": "Escherichia coli",
    "s. aureus": "Staphylococcus aureus",
    "m. tuberculosis": "Mycobacterium tuberculosis",
    "house mouse": "Mus musculus",
}


@dataclass(frozen=True)
class EngineConfig:
    """Sizes and limits of the pipeline."""

    longest_section: int = 1200
    window: int = 600
    overlap: int = 150
    neighbours: int = 5
    aliases_shown: int = 5
    chunk_chars: int = 1800
    alpha: float = 0.05
    max_hops: int = 4
    max_turns: int = 8
    sources_shown: int = 8
    source_chars: int = 600
    evidence_chars: int = 300
    embedding_dim: int = 64
    embedding_batch: int = 64

    @staticmethod
    def from_env(prefix: str = "GRAPHLOOM_", environ: Mapping[str, str] | None = None) -> EngineConfig:
        """The defaults, changed by variables like ``GRAPHLOOM_WINDOW``; a value that is no number is an error."""
        env = os.environ if environ is None else environ
        given = {f.name: env[prefix + f.name.upper()] for f in fields(EngineConfig) if prefix + f.name.upper() in env}
        return EngineConfig(**{name: type(getattr(EngineConfig, name))(value) for name, value in given.items()})
