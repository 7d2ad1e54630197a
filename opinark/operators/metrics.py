"""Evaluation: class weights, threshold sweeps, confusion, per-class and span scores, ROC area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, six decimals."""
    return F.round(F.coalesce(F.try_divide(a * F.lit(1.0), b), F.lit(0.0)), 6)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates at each threshold, all in one pass over the rows."""
    y, s = F.col(label) == 1, F.col(score)
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(y & (s >= t)).alias("tp"),
            F.count_if(~y & (s >= t)).alias("fp"),
            F.count_if(y & ~(s >= t)).alias("fn"),
            F.count_if(~y & ~(s >= t)).alias("tn"),
        )
        for t in thresholds
    ]
    rows = df.where(y.isNotNull() & s.isNotNull()).agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    scored = rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return scored.withColumns({"f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "pass_rate": ratio(F.col("tp") + F.col("fp"), n)})


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, tp, n_true, n_predicted, precision, recall, f1): from the confusion counts alone."""
    counts = confusion(df, label, predicted)
    each = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col("label") == F.col("predicted")).alias("hit"))
    per = each.groupBy(F.col("x.c").alias("label")).agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("x.t")).alias("n_true"), F.sum(F.col("n") * F.col("x.p")).alias("n_predicted")
    )
    return per.withColumns({"precision": ratio(F.col("tp"), F.col("n_predicted")), "recall": ratio(F.col("tp"), F.col("n_true")), "f1": ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_predicted"))})


def macro_report(report: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1) of a class report; one row per class, so it is small."""
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("n_true") + F.col("n_predicted")), F.lit(0.0))
    return report.agg(
        ratio(F.sum("tp"), F.sum("n_true")).alias("accuracy"), F.round(F.avg(f), 6).alias("macro_f1"), F.round(F.try_divide(F.sum(f * F.col("n_true")), F.sum("n_true")), 6).alias("weighted_f1")
    )


def set_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 over sets per row, exact-match share and tp / (tp + fp + fn)."""
    empty = F.array().cast("array<string>")
    g, p = (F.array_distinct(F.coalesce(F.col(c), empty)) for c in (gold, predicted))
    hit = F.size(F.array_intersect(g, p))
    sums = df.select(hit.alias("tp"), (F.size(p) - hit).alias("fp"), (F.size(g) - hit).alias("fn")).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")), ratio(F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)), F.count("*")).alias("exact_match")
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "jaccard": ratio(tp, tp + fp + fn)})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties half. Rows collapse to counts per score before any window."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    # scores per range, so that the running sum of a range starts from the sum of those below
    ranged = counts.withColumn("r", F.floor(F.col("s") * 256))
    totals = ranged.groupBy("r").agg(F.sum("neg").alias("n"))
    below = totals.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(below), "r").withColumn("under", F.col("base") + F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    return placed.agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg").cast("double")), 6).alias("auc"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, inverse_sqrt, balanced): inverse-sqrt weights with mean 1 clamped to [.25, 5], and n / (k count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.avg(1 / F.sqrt("n")).alias("mean_inverse"))
    joined = counts.crossJoin(F.broadcast(total))
    raw = (1 / F.sqrt("n")) / F.col("mean_inverse")
    return joined.select(label, "n", F.round(F.least(F.greatest(raw, F.lit(0.25)), F.lit(5.0)), 6).alias("inverse_sqrt"), F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("balanced"))


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    return df.agg(ratio(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("pos_weight"))


def best_row(df: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the greatest metric, the first by order on ties."""
    return df.orderBy(F.desc(metric), order).limit(1)


def span_sweep(df: DataFrame, gold: str, spans: str, thresholds: Sequence[float]) -> DataFrame:
    """set_scores of the gold aspects against the spans' aspects of at least each threshold's confidence; one pass over df."""
    each = df.select(F.col(gold).alias("_g"), F.col(spans).alias("_s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    empty = F.array().cast("array<string>")
    g = F.array_distinct(F.coalesce("_g", empty))
    p = F.array_distinct(F.transform(F.filter(F.col("_s"), lambda s: s["confidence"] >= F.col("threshold")), lambda s: s["aspect"]))
    hit = F.size(F.array_intersect(g, F.coalesce(p, empty)))
    counted = each.select("threshold", hit.alias("tp"), (F.size(F.coalesce(p, empty)) - hit).alias("fp"), (F.size(g) - hit).alias("fn"))
    sums = counted.groupBy("threshold").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")), ratio(F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)), F.count("*")).alias("exact_match"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "jaccard": ratio(tp, tp + fp + fn)})


def span_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro scores over index spans, arrays of (start, end) per row."""
    as_text = lambda c: F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return set_scores(df.select(as_text(gold).alias("g"), as_text(predicted).alias("p")), "g", "p")


def token_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 over the tokens that are not O, labels compared place by place."""
    each = df.select(F.explode(F.zip_with(gold, predicted, lambda g, p: F.struct(g.alias("g"), p.alias("p")))).alias("x"))
    g, p = F.col("x.g"), F.col("x.p")
    sums = each.agg(F.count_if((g != "O") & (g == p)).alias("tp"), F.count_if((p != "O") & (g != p)).alias("fp"), F.count_if((g != "O") & (g != p)).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
