import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.functions import text as T
from graphloom.operators import chunking


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column.alias("r")).first()["r"]


def test_repeated_lines_by_count_length_and_words(spark):
    head, rare, long = "Running head", "three times", "x" * 120
    many = " ".join("w" * 1 for _ in range(15))
    text = "\n".join([head] * 4 + [rare] * 3 + [long] * 4 + [many] * 4 + ["# Keep"] * 4 + ["", "body"])
    out = one(spark, T.without_repeated_lines(F.col("t")), t=text)
    assert head not in out and out.count(rare) == 3 and out.count(long) == 4 and out.count(many) == 4 and out.count("# Keep") == 4


def test_line_ends_and_blank_lines(spark):
    assert one(spark, T.newlines(F.col("t")), t="a\r\nb\rc") == "a\nb\nc"
    assert one(spark, T.collapsed_blanks(F.col("t")), t="a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"
    assert one(spark, T.without_repeated_lines(F.col("t")), t="a\x0cb\n") == "a\nb"


def test_captions_headings_and_titles(spark):
    assert one(spark, T.quoted_captions(F.col("t")), t="Figure 2. Cells\nno Fig 3") == "> Figure 2. Cells\nno Fig 3"
    assert one(spark, T.caps_headings(F.col("t")), t="RESULTS OF ABC2DEF\nText") == "## Results Of Abc2Def\nText"
    assert one(spark, T.with_title(F.col("t"), F.col("s")), t="x", s="my_paper-one") == "# My Paper One\n\nx"
    assert one(spark, T.title_of(F.col("t"), F.col("s")), t="a\n#  Title \n# B", s="stem") == "Title"


@pytest.mark.parametrize(("n", "pieces"), [(1200, 1), (1201, 3), (1500, 3), (1501, 4), (1950, 4), (1951, 5)])
def test_windows_at_the_edges(spark, n, pieces):
    df = spark.createDataFrame([("p", " ".join(map(str, range(n))))], "paper_id string, text string")
    rows = chunking.chunks(df).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(pieces))
    if pieces > 1:
        assert rows[0]["text"].split()[-150:] == rows[1]["text"].split()[:150] and rows[1]["section"] == "Introduction:part_1"
        assert rows[-1]["text"].split()[-1] == str(n - 1)


def test_chunking_moves_no_text_and_numbers_long_documents(spark):
    parts = ["intro"]
    for i in range(700):
        parts.append(f"## S{i}\n" + ("" if i % 50 == 7 else " ".join(["w"] * (1300 if i % 100 == 3 else 3))))
    text = "\n".join(parts)
    df = spark.createDataFrame([("p", text)], "paper_id string, text string").repartition(1)
    out = chunking.chunks(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "Window" not in plan
    rows = out.orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len(rows) == 1 + 700 - 14 + 2 * 7
    assert all(text[r["char_offset"] :].startswith("## " + r["section"].partition(":")[0]) for r in rows[1:])
    assert all(r["word_count"] == len(r["text"].split()) for r in rows)


def test_sections(spark):
    text = "# H1\nbefore\n## Empty\n**Bold**\nbody one\n\n## Last\n"
    df = spark.createDataFrame([("p", text), ("empty", ""), ("null", None)], "paper_id string, text string")
    rows = {(r["paper_id"], r["section"]): r for r in chunking.sections(df).collect()}
    assert set(rows) == {("p", "Preamble"), ("p", "Bold"), ("empty", "Introduction")}
    assert rows["p", "Bold"]["char_offset"] == text.index("**Bold**") and rows["p", "Bold"]["body"] == "body one"


def wilson(k, n, z=stats.z_score()):
    if n == 0:
        return 0.0, 1.0
    if k in (0, n):
        return (0.0, 0.0) if k == 0 else (1.0, 1.0)
    p, s = k / n, 1 + z * z / n
    m, r = (p + z * z / (2 * n)) / s, z / s * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return round(max(0, m - r), 4), round(min(1, m + r), 4)


def test_wilson(spark):
    grid = [(k, n) for n in range(0, 40) for k in range(n + 1)]
    rows = spark.createDataFrame(grid, "k int, n int").select("k", "n", stats.wilson(F.col("k"), F.col("n")).alias("c")).collect()
    assert all((r["c"]["lower"], r["c"]["upper"]) == wilson(r["k"], r["n"]) for r in rows)


def test_logprob_interval(spark):
    c = one(spark, stats.logprob_interval(F.col("p")), p=[math.log(0.5)] * 5)
    assert (c["lower"], c["upper"]) == wilson(2, 5)  # 2.5 rounds to even
    assert tuple(one(spark, stats.logprob_interval(F.col("p")), p=[])) == (0.0, 1.0)
    assert tuple(one(spark, stats.logprob_interval(F.col("p"), enabled=False), p=[-1.0])) == (0.0, 1.0)


def test_confidence_record(spark):
    rows = [(150.9, "High", 0.9, 0.2), (-10.0, "odd", -1.0, 2.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "score double, label string, lower_bound double, upper_bound double")
    extra = [F.lit(None).cast("string").alias("rationale"), F.lit(None).cast("int").alias("evidence_count"), F.lit(None).cast("string").alias("contradictions")]
    got = [r["c"] for r in df.select(stats.confidence_record(F.struct("*", *extra)).alias("c")).collect()]
    assert [(c["score"], c["label"], c["lower_bound"], c["upper_bound"]) for c in got] == [(100, "High", 0.2, 0.9), (0, "Medium", 0.0, 1.0), (50, "Medium", 0.3, 0.7)]


@given(st.integers(0, 3000))
def test_window_starts_cover_everything(n):
    starts = [s for s in range(0, max(n, 1), 450) if s == 0 or s + 150 < n]
    assert starts[0] == 0 and starts[-1] + 600 >= n
