"""Pseudo-labels: gate and sentiment scores to high- and low-confidence rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer adds its columns to a frame; models stay outside the library.
Scorer = Callable[[DataFrame], DataFrame]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kept_spans(spans: Column | str, gate: Column | str, gate_high: float = 0.90, span_min: float = 0.85) -> Column:
    """Spans of enough confidence where the gate says there is an aspect, else none."""
    s = _c(spans)
    return F.when(_c(gate) >= gate_high, F.filter(s, lambda x: x["confidence"] >= span_min)).otherwise(F.slice(s, 1, 0))


def is_ate_high(gate: Column | str, n_aspects: Column, gate_low: float = 0.10, gate_high: float = 0.90) -> Column:
    """Surely without aspect, or surely with one and one kept; null scores are not high."""
    g = _c(gate)
    return F.coalesce((g <= gate_low) | ((g >= gate_high) & (n_aspects >= 1)), F.lit(False))


def split_buckets(df: DataFrame, high: Column, into: str = "confidence_bucket") -> DataFrame:
    return df.withColumn(into, F.when(high, "high").otherwise("low"))


def merge_buckets(high: DataFrame, low: DataFrame, into: str = "confidence_bucket") -> DataFrame:
    """High and low rows as one table; columns that one side lacks are null there."""
    return high.withColumn(into, F.lit("high")).unionByName(low.withColumn(into, F.lit("low")), allowMissingColumns=True)


def argmax(probabilities: Column | str) -> Column:
    """Place of the greatest probability from 0, the first on ties."""
    p = _c(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def is_asc_high(sentiments: Column | str, polar: float = 0.90, neutral: float = 0.55) -> Column:
    """Every aspect's greatest probability reaches the threshold of its class."""
    return F.forall(_c(sentiments), lambda p: F.array_max(p) >= F.when(argmax(p) == 1, neutral).otherwise(polar))


def pairs(df: DataFrame, aspects: str) -> DataFrame:
    """One row per aspect with its place, for scoring."""
    return df.select("*", F.posexplode(aspects).alias("aspect_no", "aspect"))


def regroup(scored: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """The pairs' values as one array per row, in the order of the aspects. A row's aspects are few."""
    listed = scored.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("aspect_no", value))).alias("_v"))
    return listed.select(key, F.transform("_v", lambda x: x[value]).alias(into))


def ate_stats(df: DataFrame, aspects: str, bucket: str, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.coalesce(F.size(aspects), F.lit(0))
    high = F.col(bucket) == "high"
    stats = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(high).alias("n_high"),
        F.count_if(high & (n > 0)).alias("n_with_aspect"),
        F.coalesce(F.sum(F.when(high, n)), F.lit(0)).cast("bigint").alias("n_aspects"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(a) * F.lit(1.0), F.col(b)), F.lit(0.0)), 6)

    return stats.withColumns({"high_rate": ratio("n_high", "n_rows"), "aspects_per_high": ratio("n_aspects", "n_high"), "aspects_per_positive": ratio("n_aspects", "n_with_aspect")})


def sentiment_distribution(df: DataFrame, sentiments: str) -> DataFrame:
    """(sentiment 0..2, n, share) over all aspects, by greatest probability."""
    each = df.select(F.explode(sentiments).alias("p")).select(argmax("p").alias("sentiment"))
    counts = each.groupBy("sentiment").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("sentiment", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
