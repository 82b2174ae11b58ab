"""Problem 8: mixing sources to target weights, with capped repetition and a report of the actual shares.

Method: hierarchical budgeting. The target shares of the sources are summed up a tree (domain, language, source); the
total budget is handed down it in proportion to them. A source can give at most its tokens times its ``max_repeats``;
what it can't give goes to its siblings in proportion to their shares, and only what they can't give either to the
relatives of its ancestors. Each source then gives whole epochs of its documents and, of one more epoch in a seeded
order of its own, the prefix whose tokens come nearest to the rest of its budget.

At scale: documents move as (key, source, size) only. A source's prefix is found by sums over hash ranges of about
``RANGE`` documents, so no source, however large, is sorted in one task; only its one range that the prefix ends in is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokenize
from graphloom.plans.stage import staged

RANGE = 4096
#: The most rows of targets; the tree is planned on the driver.
MOST_TARGETS = 100_000


@dataclass
class Node:
    weight: float = 0.0
    most: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def _hand_down(node: Node, budget: float) -> None:
    """Give the budget to the children by weight; what one can't take goes to its siblings."""
    node.budget = min(budget, node.most)
    open_, left = [c for c in node.children.values() if c.weight > 0 and c.most > 0], node.budget
    given = {id(c): 0.0 for c in open_}
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_)
        full = [c for c in open_ if given[id(c)] + left * c.weight / total >= c.most]
        if not full:
            for c in open_:
                given[id(c)] += left * c.weight / total
            break
        for c in full:
            left -= c.most - given[id(c)]
            given[id(c)] = c.most
        open_ = [c for c in open_ if c not in full]
    for c in node.children.values():
        _hand_down(c, given.get(id(c), 0.0))


def budgets(targets: list[dict], sizes: dict[str, int], levels: list[str], total: float) -> dict[str, float]:
    """Tokens that each source shall give; ``levels`` are the fields of a target from the root down to the source."""
    root = Node()
    leaves = {}
    for t in targets:
        path, node = [root], root
        for level in levels:
            node = node.children.setdefault(str(t.get(level)), Node())
            path.append(node)
        share, most = float(t["target_share"] or 0), sizes.get(t["source"], 0) * max(0, t["max_repeats"] or 0)
        for n in path:
            n.weight += share
            n.most += most
        leaves[t["source"]] = node
    _hand_down(root, total)
    return {source: node.budget for source, node in leaves.items()}


def _sized(df: DataFrame, key: str, text: str, source: str, vocabulary: str | None) -> DataFrame:
    wanted = df.where(F.col(key).isNotNull()).select(F.col(key), F.col(source).alias("source"), F.col(text))
    return staged(tokenize.token_counts(wanted, text, "n_tokens", vocabulary).dropDuplicates([key]), "sizes")


def plan(sizes: DataFrame, key: str, targets: DataFrame, levels: list[str], total: float | None, seed: int) -> DataFrame:
    """A row per target: tokens there are, budget, whole epochs, and where the prefix of the next epoch ends."""
    spark = sizes.sparkSession
    listed = [r.asDict() for r in targets.limit(MOST_TARGETS + 1).collect()]
    if len(listed) > MOST_TARGETS:
        raise ValueError("too many targets for a plan on the driver")
    listed = [t for t in {t["source"]: t for t in listed if t["source"] is not None}.values()]
    names = F.broadcast(spark.createDataFrame([(t["source"],) for t in listed], "source string"))  # at most MOST_TARGETS
    there = sizes.join(names, "source").where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    tokens, documents = {r["source"]: r["t"] for r in there}, {r["source"]: r["n"] for r in there}
    want = budgets(listed, tokens, levels, float(sum(tokens.values()) if total is None else total))
    rows = []
    for t in listed:
        s = t["source"]
        have, n = tokens.get(s, 0), documents.get(s, 0)
        epochs = int(want[s] // have) if have else 0
        ranges = 1 << max(0, math.ceil(math.log2(max(1, n) / RANGE)))
        rows.append((s, float(t["target_share"] or 0), int(t["max_repeats"] or 0), have, n, want[s], epochs, want[s] - epochs * have, ranges))
    leaf = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens long, documents long, budget double, epochs int, rest double, ranges int")
    by_range = _placed(sizes, key, leaf, seed).groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    cuts = by_range.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(leaf.select("source", "rest")), "source")
    cuts = cuts.where(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("range", "before")).alias("c"))
    return staged(leaf.join(cuts, "source", "left").select(leaf.columns + [F.col("c.range").alias("cut"), F.col("c.before").alias("before")]), "plan")


def _placed(sizes: DataFrame, key: str, leaf: DataFrame, seed: int) -> DataFrame:
    """The documents of the plan with their place in the order of the epoch that is cut, and its range."""
    placed = sizes.where("n_tokens > 0").join(F.broadcast(leaf), "source")  # a row per target
    placed = placed.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epochs", key), 1))
    return placed.withColumn("range", F.shiftright("h", 63 - 24) * F.col("ranges") / (1 << 24)).withColumn("range", F.floor("range"))


def mix(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    levels: tuple[str, ...] = ("source",),
    total: float | None = None,
    seed: int = 7,
    vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(key, source, n_tokens, copies)`` and the report, a row per target and per source outside them.

    ``total`` defaults to the tokens of all documents of the listed sources. The report has ``source, target_share,
    max_repeats, documents, tokens, budget, chosen_tokens, actual_share``. Documents without tokens (null or empty
    text), with a null or unlisted source, or a null key are not taken; a key that comes several times counts once;
    a target of a source without documents gives its share to its siblings; a null share or cap counts as 0; ties in
    the order are broken by the key; other columns don't matter; an empty table gives no rows and a report of zeros.
    """
    sizes = _sized(df, key, text, source, vocabulary)
    leaf = plan(sizes, key, targets, list(levels), total, seed)
    placed = _placed(sizes, key, leaf.drop("cut", "before"), seed).join(F.broadcast(leaf.select("source", "cut", "before")), "source")
    columns = [key, "source", "n_tokens"]
    sure = placed.where("cut IS NULL OR range <> cut").select(*columns, (F.col("epochs") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)).alias("copies"))
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.where("range = cut").withColumn("upto", F.col("before") + upto)  # about RANGE documents of a source
    taken = F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")
    edge = cut.select(*columns, (F.col("epochs") + F.when(taken & (F.col("epochs") < F.col("max_repeats")), 1).otherwise(0)).alias("copies"))
    mixture = staged(sure.unionByName(edge).where("copies > 0"), "mixture")
    chosen = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("chosen_tokens"))
    everything = chosen.agg(F.sum("chosen_tokens").alias("all"))  # one row
    others = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).join(F.broadcast(leaf.select("source")), "source", "left_anti")
    others = others.select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "documents", F.col("tokens").cast("long"), F.lit(0.0).alias("budget"))
    report = leaf.select("source", "target_share", "max_repeats", "documents", "tokens", "budget").unionByName(others)
    report = report.join(F.broadcast(chosen), "source", "left").withColumn("chosen_tokens", F.coalesce("chosen_tokens", F.lit(0)))
    report = report.withColumn("one", F.lit(1)).join(F.broadcast(everything.withColumn("one", F.lit(1))), "one").drop("one")
    return mixture, report.withColumn("actual_share", F.coalesce(F.col("chosen_tokens") / F.col("all"), F.lit(0.0))).drop("all")
