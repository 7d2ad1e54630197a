"""Cleaning stages 1 and 2: reviews to numbered sentences to filtered sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinark import lexicons
from opinark.functions import text as X

#: Stage-1 variants: how title and text merge, how text is normalised, which columns make a duplicate.
VARIANTS = {
    "electronics": (X.concat_text, X.whitelist_lower, ("review_text",)),
    "office": (X.concat_text, X.whitelist_keep_case, ("review_text", "user_id", "parent_asin")),
    "software": (X.concat_text, X.whitelist_unicode, ("parent_asin", "review_text")),
    "kindle": (X.merge_text, X.clean_html, ("parent_asin", "review_text")),
}


def not_blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in order: the defined survivor of a duplicate.

    A partial aggregate keeps one row per key and task, so a hot key does not reach one task whole.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return best.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def merge_dedup_normalize(reviews: DataFrame, variant: str, order: Sequence[str]) -> DataFrame:
    """Reviews with review_text: merged, not blank, one per duplicate, normalised, not blank again."""
    merge, normalize, keys = VARIANTS[variant]
    merged = reviews.withColumn("review_text", merge("title", "text")).where(not_blank("review_text"))
    first = first_of(merged, keys, order)
    # as a list of one text or none: a plain filter would be pushed down and normalise every text twice
    kept = F.filter(F.array(normalize("review_text")), not_blank)
    return first.select(*(c for c in first.columns if c != "review_text"), F.explode(kept).alias("review_text")).select(*first.columns)


def split_marks(df: DataFrame, text: str, position: str = "sentence_id", into: str = "sentence_text") -> DataFrame:
    """One row per non-blank stretch between . ! ? runs, numbered from 1 by its place."""
    parts = F.filter(F.transform(F.split(df[text], "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select("*", F.posexplode(parts).alias("_p", into)).withColumn(position, F.col("_p") + 1).drop("_p")


def split_lookbehind(df: DataFrame, text: str, position: str = "sentence_id", into: str = "sentence_text") -> DataFrame:
    """One row per sentence, cut at white space after . ! ?; the marks stay. A documented stand-in for a trained splitter."""
    parts = F.filter(F.transform(F.split(df[text], r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select("*", F.posexplode(parts).alias("_p", into)).withColumn(position, F.col("_p") + 1).drop("_p")


def renumber(df: DataFrame, key: str, order: Sequence[Column | str], into: str = "sentence_id") -> DataFrame:
    """Numbers from 1 within key, by order."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def tag_sentences(df: DataFrame, text: str) -> DataFrame:
    """normalized_text, tagged_text and the hit counts of both lexicons, one pass."""
    return (
        df.withColumn("normalized", X.normalize_sentence(text))
        .withColumn("tagged", X.tag_lexicon("normalized", collapsed=True))
        .withColumn("generic_hits", X.tag_count("tagged", lexicons.GENERIC_TAG))
        .withColumn("noise_hits", X.tag_count("tagged", lexicons.NOISE_TAG))
    )


def first_reason(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that holds: an ordered cascade, each row in one class."""
    out = F.lit(kept)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def short_text_audit(df: DataFrame, text: str) -> DataFrame:
    """Audit by rules that need no parse: blank, short, social, generic or noise words only."""
    tagged = tag_sentences(df, text)
    words = F.split("tagged", " ")
    all_tags = F.forall(words, lambda w: w.isin(lexicons.GENERIC_TAG, lexicons.NOISE_TAG))
    n = F.col("normalized")
    rules = [
        ("blank", n == ""),
        ("too_short", (F.length(n) < 5) | (F.size(X.tokens(n)) < 2)),
        ("social", X.is_social(n)),
        ("all_targets_generic_or_noise", all_tags),
    ]
    return tagged.withColumn("reason", first_reason(rules)).withColumn("keep_row", F.col("reason") == "kept")
