"""Queries of the training-data operators, by name, and the SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import canonical, knn, language, mixing, near_duplicates, scanned, split, tokenize
from graphloom.plans.stage import staged
from graphloom.sources.tables import first_delivery, table


def chunks_once(spark: SparkSession, directory: str, columns: list[str]) -> DataFrame:
    """Each chunk_id once, with the paper that the id tells where ``paper_id`` is null."""
    df = first_delivery(table(spark, directory, "chunks"), "chunk_id", columns)
    if "paper_id" in columns:
        df = df.withColumn("paper_id", F.coalesce("paper_id", F.regexp_replace("chunk_id", "__[^_]*$", "")))
    return df


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    entries = table(spark, directory, "entities")
    spans = canonical.unlisted(table(spark, directory, "ner_entities").select("span_id", "label", "text", "canonical_name"), entries)
    return canonical.map_values(spans, entries, table(spark, directory, "synonyms"))


def p1_unmatched(spark: SparkSession, directory: str) -> DataFrame:
    """The values that stand for no entry, with the number of their spans."""
    spans = table(spark, directory, "ner_entities").select("span_id", "label", "text").dropDuplicates(["span_id"])
    lost = p1_found(spark, directory).where("name = ''").select("span_id")
    return spans.join(lost, "span_id").groupBy("label", "text").agg(F.count(F.lit(1)).alias("n_spans"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return knn.similar_pairs(knn.neighbours(table(spark, directory, "vectors"), least=0.9))


def p2_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return knn.neighbours(table(spark, directory, "vectors"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    chunks = table(spark, directory, "chunks").select("chunk_id", "text")
    return near_duplicates.pairs(*near_duplicates.near_duplicates(chunks))


def p3_groups(spark: SparkSession, directory: str) -> DataFrame:
    chunks = table(spark, directory, "chunks").select("chunk_id", "text")
    return near_duplicates.groups(*near_duplicates.near_duplicates(chunks))


def p5_pieces(spark: SparkSession, directory: str) -> DataFrame:
    long = table(spark, directory, "chunks").where(F.length("text") > 2400)
    once = first_delivery(long, "chunk_id", ["paper_id", "section", "char_offset", "text"])
    return split.split_oversized(once.withColumn("paper_id", F.coalesce("paper_id", F.regexp_replace("chunk_id", "__[^_]*$", ""))))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return p5_pieces(spark, directory).where("piece_index = 0").select("chunk_id")


def p6_texts(spark: SparkSession, directory: str) -> DataFrame:
    """The repaired text of each scanned chunk, with its defects."""
    chunks = table(spark, directory, "chunks").select("chunk_id", "text", F.coalesce("paper_id", F.regexp_replace("chunk_id", "__[^_]*$", "")).alias("paper_id"))
    return scanned.repair_scans(chunks, table(spark, directory, "papers"), table(spark, directory, "entities"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return scanned.defects(p6_texts(spark, directory))


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, directory, "documents"))


#: The domains of this project's sources, as a table of its own; a source that it doesn't hold is a domain by itself.
DOMAINS = {
    "literature": ("open_journals", "preprint_feed", "review_archive", "congress_abstracts", "thesis_store"),
    "clinical": ("trial_registry", "case_reports", "patient_leaflets", "regional_bulletins"),
    "technical": ("patent_digest", "lab_protocols", "methods_wiki", "consortium_memos"),
}


def source_tree(documents: DataFrame, targets: DataFrame, domains: DataFrame) -> DataFrame:
    """The targets with their ``domain`` and with the ``language`` that nine tenths of their labelled documents name, else ``many``."""
    labelled = documents.select("source", F.explode(language.declared_codes(F.col("lang"))).alias("code")).where("source IS NOT NULL")
    counts = labelled.groupBy("source", "code").agg(F.count(F.lit(1)).alias("n"))  # sources x languages
    spoken = counts.groupBy("source").agg(F.max(F.struct("n", "code")).alias("top"), F.sum("n").alias("all"))
    spoken = spoken.select("source", F.when(F.col("top.n") >= 0.9 * F.col("all"), F.col("top.code")).otherwise(F.lit("many")).alias("language"))
    placed = targets.join(domains.dropDuplicates(["source"]), "source", "left").withColumn("domain", F.coalesce("domain", "source"))
    return placed.join(spoken, "source", "left").withColumn("language", F.coalesce("language", F.lit("many")))


def _mixed(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, directory, "documents")
    domains = spark.createDataFrame([(s, d) for d, sources in DOMAINS.items() for s in sources], "source string, domain string")
    targets = source_tree(documents, table(spark, directory, "mix_targets"), domains)
    return mixing.mix(documents, targets, levels=("domain", "language", "source"))


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    return _mixed(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    return _mixed(spark, directory)[1]


def p9_languages(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return language.label_languages(documents, language.sample_and_fit(documents))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return language.undeclared(p9_languages(spark, directory))


def p5_checks(spark: SparkSession, directory: str) -> DataFrame:
    """Per oversized chunk what holds of its pieces: words of the text, covered words, the least and most words shared, the longest piece."""
    pieces = staged(p5_pieces(spark, directory).select("chunk_id", "piece_index", "n_pieces", "n_words", "char_offset", F.length("text").alias("chars")), "pieces")
    after = pieces.select("chunk_id", (F.col("piece_index") - 1).alias("piece_index"), F.col("char_offset").alias("next"))
    joined = pieces.join(after, ["chunk_id", "piece_index"], "left")
    grouped = joined.groupBy("chunk_id").agg(
        (F.sum("n_words") - 150 * (F.count(F.lit(1)) - 1)).alias("covered_words"),
        (F.max("n_words") <= 600).alias("all_within_limit"),
        (F.max("n_pieces") == F.count(F.lit(1))).alias("all_numbered"),
        F.min(F.coalesce(F.col("next") < F.col("char_offset") + F.col("chars"), F.lit(True))).alias("all_overlap"),
    )
    return grouped


def p8_checks(spark: SparkSession, directory: str) -> DataFrame:
    """Per target the tokens' bounds that the mixture must keep, as true statements, and whether its documents fit its cap."""
    mixture, report = _mixed(spark, directory)
    most = mixture.groupBy("source").agg(F.max("copies").alias("most"), F.count(F.lit(1)).alias("n"))
    rows = report.where("target_share > 0").join(most, "source", "left")
    return rows.select(
        "source",
        "documents",
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"),
        (F.abs(F.col("chosen_tokens") - F.col("budget")) <= 4096).alias("near_budget"),
        (F.coalesce("n", F.lit(0)) <= F.col("documents")).alias("once_each"),
    )


def queries():
    return {"p5_checks": p5_checks, "p8_checks": p8_checks, "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_groups": p3_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_texts": p6_texts, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_languages": p9_languages}


def oracle_sql():
    words = r"len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))"
    return {
        "p5_checks": f"""
            SELECT chunk_id, max({words}) AS covered_words, true AS all_within_limit, true AS all_numbered, true AS all_overlap
            FROM chunks WHERE chunk_id IS NOT NULL AND {words} > 1200 GROUP BY 1""",
        "p8_checks": """
            SELECT t.source, count(d.doc_id) AS documents, true AS within_cap, true AS near_budget, true AS once_each
            FROM mix_targets t LEFT JOIN (SELECT * FROM documents WHERE text <> '') d ON d.source = t.source
            WHERE t.source IS NOT NULL AND t.target_share > 0 GROUP BY 1""",
        "p5_found": r"""
            SELECT DISTINCT chunk_id FROM chunks
            WHERE len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+')) > 1200 AND chunk_id IS NOT NULL""",
    }
