"""Baseline models: lexicon sentiment, n-gram and hashing classifiers, a token tagger."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, FeatureHasher, HashingTF, NGram, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinark.operators.spans import let
from opinark.runtime import lookup_join

# Words of clear polarity for the rule baseline.
POSITIVE = ("good", "great", "excellent", "love", "perfect", "nice", "happy", "easy", "best", "fast", "comfortable", "reliable", "sturdy", "useful", "beautiful")
NEGATIVE = ("bad", "poor", "terrible", "hate", "broken", "awful", "slow", "cheap", "worst", "hard", "disappointed", "useless", "flimsy", "noisy", "boring")
NEGATIONS = ("not", "no", "never")


def lexicon_sentiment(words: Column | str, cut: float = 0.05) -> Column:
    """0, 1 or 2 by the balance of polar words, turned round after a negation."""
    ws = F.col(words) if isinstance(words, str) else words

    def total(ws: Column) -> Column:
        def value(w: Column, i: Column) -> Column:
            polarity = F.when(w.isin(*POSITIVE), 1.0).when(w.isin(*NEGATIVE), -1.0).otherwise(0.0)
            negated = (i > 0) & F.coalesce(F.get(ws, i - 1).isin(*NEGATIONS), F.lit(False))
            return F.when(negated, -polarity).otherwise(polarity)

        return F.aggregate(F.transform(ws, value), F.lit(0.0), lambda a, x: a + x)

    def label(t: Column) -> Column:
        score = t / F.sqrt(t * t + 15)
        return F.when(score >= cut, 2).when(score <= -cut, 0).otherwise(1)

    return let(let(ws, total), label)


def learn_lexicon(rated: DataFrame, words: str, label: str, least: int = 5) -> DataFrame:
    """(word, valence) of words that `least` rows or more hold: how much likelier they are in rows labelled 2 than in rows labelled 0.

    Smoothed logarithm of the ratio, to six decimals; other labels do not count.
    """
    each = rated.where(F.col(label).isin(0, 2)).select(F.explode(F.array_distinct(words)).alias("word"), (F.col(label) == 2).alias("up"))
    counts = each.groupBy("word").agg(F.count_if("up").alias("p"), F.count_if(~F.col("up")).alias("n")).where(F.col("p") + F.col("n") >= least)
    totals = rated.agg(F.count_if(F.col(label) == 2).alias("np"), F.count_if(F.col(label) == 0).alias("nn"))  # one row
    ratio = F.log((F.col("p") + 1) / (F.col("np") + 2)) - F.log((F.col("n") + 1) / (F.col("nn") + 2))
    return counts.crossJoin(F.broadcast(totals)).select("word", F.round(ratio, 6).alias("valence"))


def learned_sentiment(df: DataFrame, key: str, words: str, lexicon: DataFrame, cut: float = 0.05) -> DataFrame:
    """(key, score, sentiment 0..2): the balance of the words' valences, turned round after a negation; without known words 1."""
    each = df.select(key, F.posexplode(words).alias("_i", "word"), F.col(words).alias("_ws"))
    turned = F.coalesce(F.get("_ws", F.col("_i") - 1).isin(*NEGATIONS), F.lit(False)) & (F.col("_i") > 0)
    found = lookup_join(each.select(key, "word", turned.alias("_t")), lexicon, ["word"])
    total = found.groupBy(key).agg(F.round(F.sum(F.when(F.col("_t"), -F.col("valence")).otherwise(F.col("valence"))), 5).alias("_s"))
    score = F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15), 5)
    scored = df.select(key).distinct().join(total, key, "left").select(key, F.coalesce(score, F.lit(0.0)).alias("score"))
    return scored.withColumn("sentiment", F.when(F.col("score") >= cut, 2).when(F.col("score") <= -cut, 0).otherwise(1))


def balanced(df: DataFrame, label: str, into: str = "class_weight") -> DataFrame:
    """Rows with weight n / (k * count of their class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    weights = counts.crossJoin(totals).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(into))
    return df.join(F.broadcast(weights), label)


def tfidf_classifier(df: DataFrame, words: str, label: str, vocabulary: int = 20_000) -> PipelineModel:
    """Words and word pairs by TF-IDF into a balanced logistic regression."""
    both = df.withColumn("_grams", F.concat(words, F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: i >= 0), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))))
    steps = [
        CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=vocabulary),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, weightCol="class_weight", maxIter=20),
    ]
    return Pipeline(stages=steps).fit(balanced(both, label))


def hashing_classifier(df: DataFrame, words: str, label: str, features: int = 1 << 18) -> PipelineModel:
    steps = [HashingTF(inputCol=words, outputCol="_features", numFeatures=features), LogisticRegression(featuresCol="_features", labelCol=label, weightCol="class_weight", maxIter=20)]
    return Pipeline(stages=steps).fit(balanced(df, label))


def token_features(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """One row per token: lower form, neighbours, prefix, suffix, shape and position bin."""
    each = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    order = Window.partitionBy(key).orderBy("pos")
    t = F.col("token")
    return each.select(
        key, "pos", "token", F.lower(t).alias("lower"),
        F.lower(F.lag("token", 1, "<BOS>").over(order)).alias("prev"), F.lower(F.lead("token", 1, "<EOS>").over(order)).alias("next"),
        F.lower(F.substring(t, 1, 3)).alias("prefix3"), F.lower(F.substring(t, -3, 3)).alias("suffix3"),
        (t == F.initcap(t)).alias("is_title"), F.regexp_like(t, F.lit("^[0-9]+$")).alias("is_digit"), F.least(F.expr("pos div 5"), F.lit(10)).cast("int").alias("position_bin"),
    )


def token_tagger(features: DataFrame, label: str, size: int = 1 << 16) -> PipelineModel:
    """A multinomial regression over hashed token features."""
    names = ["lower", "prev", "next", "prefix3", "suffix3", "is_title", "is_digit", "position_bin"]
    text = features.select("*", *(F.col(c).cast("string").alias(f"_{c}") for c in names))
    steps = [StringIndexer(inputCol=label, outputCol="_label"), FeatureHasher(inputCols=[f"_{c}" for c in names], outputCol="_features", numFeatures=size), LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=10)]
    return Pipeline(stages=steps).fit(text)
