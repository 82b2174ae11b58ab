"""Queries over texts: clean-up passes, sections, windows and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import chunking
from graphloom.sources.tables import first_delivery, table

def _stem():
    return F.coalesce("source", F.lit("un-named_source"))



def _per_document(make):
    def query(spark, directory):
        documents = table(spark, directory, "documents").where("text IS NOT NULL")
        return documents.select("doc_id", make(T.newlines(F.col("text"))).alias("result"))

    return query


def _markdown(spark, directory):
    return table(spark, directory, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("paper_id"), "text")


def chunk_sections(spark, directory):
    return chunking.sections(_markdown(spark, directory)).drop("pos")


def chunk_documents(spark, directory):
    return chunking.chunks(_markdown(spark, directory))


def chunk_windows(spark, directory):
    """Windows over the stored chunks, which are sections already."""
    once = first_delivery(table(spark, directory, "chunks"), "chunk_id", ["section", "text"]).where("text IS NOT NULL")
    parts = chunking.windows(once.withColumnRenamed("text", "body"))
    return parts.select("chunk_id", "section", "part", "body", T.word_count(F.col("body")).alias("n_words"))


def word_counts(spark, directory):
    once = first_delivery(table(spark, directory, "chunks"), "chunk_id", ["text", "word_count"])
    n = F.when(F.col("text").isNotNull(), T.word_count(F.col("text")))
    return once.select("chunk_id", n.alias("n_words"), (F.col("word_count") != n).alias("stale"))


def chunk_ids(spark, directory):
    once = first_delivery(table(spark, directory, "chunks"), "chunk_id", ["paper_id", "chunk_index"])
    paper = F.coalesce("paper_id", F.regexp_replace("chunk_id", "__[^_]*$", ""))
    return once.select("chunk_id", paper.alias("paper_id"), F.format_string("%s__%04d", paper, "chunk_index").alias("rebuilt"))


def queries():
    return {
        "strip_repeated_lines": _per_document(T.without_repeated_lines),
        "figure_captions": _per_document(T.quoted_captions),
        "collapse_blank": _per_document(T.collapsed_blanks),
        "title_header": _per_document(lambda t: T.with_title(t, _stem())),
        "caps_headings": _per_document(T.caps_headings),
        "clean_markdown": _per_document(lambda t: T.cleaned_markdown(t, _stem())),
        "paper_titles": _per_document(lambda t: T.title_of(t, _stem())),
        "chunk_sections": chunk_sections,
        "chunk_documents": chunk_documents,
        "chunk_windows": chunk_windows,
        "word_counts": word_counts,
        "chunk_ids": chunk_ids,
    }


WS = T.WS
DOCS = r"d AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t, coalesce(source, 'un-named_source') AS stem FROM documents WHERE text IS NOT NULL)"
ONCE = "o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS LAST) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


REPEATED = rf"""
, l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM
        (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM
         (SELECT doc_id, string_split_regex(t, '[\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM d)))
, noise AS (SELECT doc_id, {sql_strip('line')} AS s FROM l GROUP BY 1, 2
            HAVING count(*) > 3 AND s <> '' AND length(s) < 120 AND s NOT LIKE '#%' AND len({sql_words('s')}) < 15)
, kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS r FROM l LEFT JOIN noise n ON n.doc_id = l.doc_id AND n.s = {sql_strip('line')}
           WHERE n.s IS NULL GROUP BY 1)
, rep AS (SELECT d.doc_id, d.stem, coalesce(r, '') AS t FROM d LEFT JOIN kept USING (doc_id))"""
CAPTION = rf"(?im)^(fig(?:ure)?\.?{WS}*\d+[a-zA-Z]?[.:–\-]?{WS}*.{{0,200}})$"


def sql_title_case(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


def sql_with_title(t: str) -> str:
    return f"CASE WHEN regexp_replace({t}, '^{WS}+', '') LIKE '# %' THEN {t} ELSE '# ' || {sql_title_case("regexp_replace(stem, '[_-]', ' ', 'g')")} || chr(10) || chr(10) || {t} END"


HEADER = rf"(?m)^(#{{2,6}}{WS}+.+|(?:\*\*[^*\n]+\*\*){WS}*)$"
SECTIONS = rf"""
m AS (SELECT 'd' || doc_id AS paper_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)
, x AS (SELECT paper_id, string_split_regex(t, '{HEADER}') AS b, regexp_extract_all(t, '{HEADER}', 1) AS h FROM m)
, y AS (SELECT paper_id, len(h) AS nh, unnest(b) AS body, unnest(list_concat([NULL], h)) AS head, generate_subscripts(b, 1) AS pos FROM x)
, z AS (SELECT *, coalesce(sum(length(body) + coalesce(length(head), 0)) OVER (PARTITION BY paper_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM y)
, sec AS (SELECT paper_id, pos, CAST(off AS INT) AS char_offset,
          CASE WHEN nh = 0 THEN 'Introduction' WHEN pos = 1 THEN 'Preamble'
               ELSE {sql_strip(rf"regexp_replace(regexp_replace({sql_strip('head')}, '^#{{2,6}}{WS}+', ''), '^\*\*(.+)\*\*$', '\1')")} END AS section,
          CASE WHEN nh = 0 THEN body ELSE {sql_strip('body')} END AS body FROM z WHERE nh = 0 OR {sql_strip('body')} <> '')"""


def sql_windows(source: str, keep: str) -> str:
    return rf"""
, w AS (SELECT *, {sql_words('body')} AS ws FROM {source})
, win AS (SELECT {keep}, section, 0 AS part, {sql_strip('body')} AS body FROM w WHERE len(ws) <= 1200
          UNION ALL
          SELECT {keep}, section || ':part_' || CAST(i AS VARCHAR), i, array_to_string(ws[i * 450 + 1 : i * 450 + 600], ' ')
          FROM (SELECT *, unnest(range(0, 1 + CAST(ceil((len(ws) - 600) / 450.0) AS BIGINT))) AS i FROM w WHERE len(ws) > 1200))"""


def oracle_sql():
    return {
        "strip_repeated_lines": f"WITH {DOCS}{REPEATED} SELECT doc_id, t AS result FROM rep",
        "figure_captions": rf"WITH {DOCS} SELECT doc_id, regexp_replace(t, '{CAPTION}', '> \1', 'g') AS result FROM d",
        "collapse_blank": rf"WITH {DOCS} SELECT doc_id, regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') AS result FROM d",
        "title_header": f"WITH {DOCS} SELECT doc_id, {sql_with_title('t')} AS result FROM d",
        "caps_headings": rf"""WITH {DOCS} SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda line:
            CASE WHEN upper({sql_strip('line')}) = {sql_strip('line')} AND lower({sql_strip('line')}) <> {sql_strip('line')} AND length({sql_strip('line')}) < 80
                 THEN '## ' || {sql_title_case(sql_strip('line'))} ELSE line END), chr(10)) AS result FROM d""",
        "clean_markdown": rf"""WITH {DOCS}{REPEATED}, c AS (SELECT doc_id, stem, regexp_replace(regexp_replace(t, '{CAPTION}', '> \1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM rep)
            SELECT doc_id, {sql_with_title('t')} AS result FROM c""",
        "paper_titles": rf"WITH {DOCS} SELECT doc_id, coalesce(nullif({sql_strip(f"regexp_extract(t, '(?m)^#{WS}+(.+)$', 1)")}, ''), stem) AS result FROM d",
        "chunk_sections": f"WITH {SECTIONS} SELECT paper_id, section, body, char_offset FROM sec",
        "chunk_documents": f"""WITH {SECTIONS}{sql_windows('sec', 'paper_id, pos, char_offset')}
            , num AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos, part) - 1 AS i FROM win)
            SELECT paper_id || '__' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INT), '0') AS chunk_id, paper_id, section,
                   CAST(i AS INT) AS chunk_index, body AS text, char_offset, len({sql_words('body')}) AS word_count FROM num""",
        "chunk_windows": f"""WITH {ONCE}, src AS (SELECT chunk_id, section, text AS body FROM o WHERE text IS NOT NULL){sql_windows('src', 'chunk_id')}
            SELECT chunk_id, section, part, body, len({sql_words('body')}) AS n_words FROM win""",
        "word_counts": f"WITH {ONCE}, n AS (SELECT chunk_id, word_count, CASE WHEN text IS NOT NULL THEN len({sql_words('text')}) END AS n_words FROM o) SELECT chunk_id, n_words, word_count <> n_words AS stale FROM n",
        "chunk_ids": f"""WITH {ONCE}, p AS (SELECT chunk_id, chunk_index, coalesce(paper_id, regexp_replace(chunk_id, '__[^_]*$', '')) AS paper_id FROM o)
            SELECT chunk_id, paper_id, paper_id || '__' || lpad(CAST(chunk_index AS VARCHAR), CAST(greatest(4, length(CAST(chunk_index AS VARCHAR))) AS INT), '0') AS rebuilt FROM p""",
    }
