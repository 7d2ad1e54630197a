"""A score cutoff per source that keeps a target fraction of its rows (problem 4).

Iterative histogram refinement: scores are counted into equal bins per source, the bin that holds
the target rank becomes the next range, and so on until that bin holds one distinct score. Every
round aggregates at most bins x sources rows map-side; no row is sorted or moved, so a source with
most of the rows costs no more than others.

Defined results: rows with a null source, a source without target, or a score that is null, NaN
or outside [low, high] are not scored; repeated rows count each; rows tied at the cutoff are all
kept; a source without scored rows has no cutoff; a fraction of 0 keeps nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.runtime import cut, discard, lookup_join, name_key

MAX_ROUNDS = 64


def scored_rows(rows: DataFrame, targets: DataFrame, source: str, score: str, target_source: str, fraction: str, keep: Sequence[str] = ("row_id",), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The scored rows: the columns of keep, source_key, score_value and, from targets, source_name and fraction."""
    wanted = targets.select(name_key(target_source).alias("source_key"), F.col(target_source).alias("source_name"), F.col(fraction).alias("fraction"))
    value = F.col(score)
    valid = value.isNotNull() & ~F.isnan(value) & value.between(low, high)
    kept = rows.where(F.col(source).isNotNull() & valid).select(*keep, name_key(source).alias("source_key"), value.alias("score_value"))
    return lookup_join(kept, wanted, ["source_key"])


def cutoffs(scored: DataFrame, bins: int = 256) -> DataFrame:
    """(source_name, n_scored, n_kept, cutoff): the highest score at or above which enough rows lie."""
    data = scored.select("source_name", "score_value", "fraction")
    # ceil(n * fraction) in whole numbers: fractions are exact to six decimals
    parts = F.round(F.col("fraction") * 1_000_000).cast("long")
    state = data.groupBy("source_name").agg(
        F.count("*").alias("n_scored"), F.min("score_value").alias("lo"), F.max("score_value").alias("hi"), F.max(parts).alias("parts")
    )
    state = state.select(
        "source_name", "n_scored", "lo", "hi", F.expr("(n_scored * parts + 999999) div 1000000").alias("wanted"), F.lit(0).cast("long").alias("above")
    ).where("wanted > 0")
    state = cut(state, "cutoff-state")
    for _ in range(MAX_ROUNDS):
        if not state.where("lo < hi").limit(1).count():
            break
        open_ranges = state.where("lo < hi").select("source_name", "lo", "hi", "wanted", "above", "n_scored")
        inside = lookup_join(data.select("source_name", "score_value"), open_ranges.select("source_name", "lo", "hi"), ["source_name"]).where("score_value between lo and hi")
        place = F.least(F.floor((F.col("score_value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy("source_name", place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("score_value").alias("bin_lo"), F.max("score_value").alias("bin_hi")
        )
        # at most `bins` rows a source: array work inside one row instead of a window over the source
        per_source = counts.groupBy("source_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("order"), "n", "bin_lo", "bin_hi"))).alias("hist"))
        walked = per_source.join(open_ranges.select("source_name", "n_scored", "wanted", "above"), "source_name").withColumn(
            "hit",
            F.expr(
                """aggregate(hist, named_struct('above', above, 'done', false, 'lo', 0D, 'hi', 0D),
                   (s, b) -> if(s.done, s, if(s.above + b.n >= wanted,
                      named_struct('above', s.above, 'done', true, 'lo', b.bin_lo, 'hi', b.bin_hi),
                      named_struct('above', s.above + b.n, 'done', false, 'lo', 0D, 'hi', 0D))))"""
            ),
        )
        moved = walked.select("source_name", "n_scored", F.col("hit.lo").alias("lo"), F.col("hit.hi").alias("hi"), "wanted", F.col("hit.above").alias("above"))
        new = cut(state.where("lo >= hi").unionByName(moved), "cutoff-state")
        discard(state)
        state = new
    else:
        raise RuntimeError("cutoffs did not settle")
    found = state.select("source_name", "n_scored", F.col("lo").alias("cutoff"))
    kept = lookup_join(data.select("source_name", "score_value"), found.select("source_name", "cutoff"), ["source_name"]).where("score_value >= cutoff")
    sizes = kept.groupBy("source_name").agg(F.count("*").alias("n_kept"))
    return found.join(sizes, "source_name").select("source_name", "n_scored", "n_kept", "cutoff")


def kept_rows(scored: DataFrame, found: DataFrame) -> DataFrame:
    """The scored rows at or above their source's cutoff."""
    return lookup_join(scored, found.select("source_name", "cutoff"), ["source_name"]).where("score_value >= cutoff")
