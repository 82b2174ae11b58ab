"""Proportion intervals and confidence records as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(alpha: float = 0.05) -> float:
    """The two-sided normal quantile; computed once on the driver."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson(k: Column, n: Column, alpha: float = 0.05, boundary: str = "certain") -> Column:
    """``STRUCT<lower, upper>``: the Wilson score interval of ``k`` out of ``n``, in [0, 1], to four places.

    ``n = 0`` gives (0, 1). With ``boundary="certain"`` no and full agreement give (0, 0) and (1, 1); with
    ``"wilson"`` they get their true intervals.
    """
    z = z_score(alpha)
    k, n = k.cast("double"), n.cast("double")
    p, zz = k / n, z * z
    scale = 1 + F.lit(zz) / n
    middle = (p + F.lit(zz) / (2 * n)) / scale
    reach = (F.lit(z) / scale) * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n))
    lower, upper = F.round(F.greatest(F.lit(0.0), middle - reach), 4), F.round(F.least(F.lit(1.0), middle + reach), 4)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("lower"), b.alias("upper"))

    out = F.when(n == 0, pair(F.lit(0.0), F.lit(1.0)))
    if boundary == "certain":
        out = out.when(k == 0, pair(F.lit(0.0), F.lit(0.0))).when(k == n, pair(F.lit(1.0), F.lit(1.0)))
    return out.otherwise(pair(lower, upper))


def logprob_interval(logprobs: Column, enabled: bool = True, alpha: float = 0.05) -> Column:
    """The interval of a token sequence from its mean log probability; (0, 1) without any, or when not enabled."""
    n = F.coalesce(F.size(logprobs), F.lit(0))
    whole = F.struct(F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"))
    if not enabled:
        return whole
    mean = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / n
    p = F.least(F.greatest(F.exp(mean), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return F.when(n > 0, wilson(F.bround(p * n), n, alpha)).otherwise(whole)


def confidence_record(raw: Column) -> Column:
    """A calibrator's record with defaults, limits and order put right.

    ``raw`` is a struct with any of ``score DOUBLE, label, lower_bound DOUBLE, upper_bound DOUBLE, rationale,
    evidence_count, contradictions``, null where missing.
    """
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(raw["score"], F.lit(50.0)).cast("int")))
    low = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["lower_bound"], F.lit(0.3))))
    high = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["upper_bound"], F.lit(0.7))))
    return F.struct(
        score.alias("score"),
        F.when(raw["label"].isin("High", "Medium", "Low"), raw["label"]).otherwise(F.lit("Medium")).alias("label"),
        F.least(low, high).alias("lower_bound"),
        F.greatest(low, high).alias("upper_bound"),
        # fixed values: what stands for a missing rationale and for missing contradictions
        F.coalesce(raw["rationale"], F.lit("Confidence could not be determined.")).alias("rationale"),
        F.coalesce(raw["evidence_count"], F.lit(0)).alias("evidence_count"),
        F.coalesce(raw["contradictions"], F.lit("none")).alias("contradictions"),
    )


def interval_text(lower: Column, upper: Column) -> Column:
    """``[0.12, 0.34]``; rounded from the exact binary values, halves to even, as ``format_number`` does."""
    return F.concat(F.lit("["), F.format_number(lower, 2), F.lit(", "), F.format_number(upper, 2), F.lit("]"))


def badge(record: Column) -> Column:
    """What a confidence record shows: colour, fraction, interval, and contradictions unless there are none."""
    colour = F.when(record["label"] == "High", "green").when(record["label"] == "Low", "red").otherwise("orange")
    return F.struct(
        colour.alias("colour"),
        (record["score"] / 100).alias("fraction"),
        interval_text(record["lower_bound"], record["upper_bound"]).alias("interval"),
        F.when(F.lower(record["contradictions"]) != "none", record["contradictions"]).alias("contradictions"),
    )
