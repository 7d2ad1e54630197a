"""Aspect-opinion-sentiment triplets: parsing, checks, serial forms, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinark.lexicons import SENTIMENTS
from opinark.schemas import TRIPLETS

# Names and numbers of sentiments in hand-written labels.
SENTIMENT_WORDS = {
    "negative": 0, "neg": 0, "-1": 0, "0": 0,
    "neutral": 1, "neu": 1, "1": 1,
    "positive": 2, "pos": 2, "+1": 2, "2": 2,
}
_ALIASES = "array<struct<aspect_phrase:string,aspect:string,a:string,opinion_phrase:string,opinion:string,o:string,sentiment_int:string,sentiment:string,s:string>>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_code(c: Column | str) -> Column:
    """0, 1 or 2 of a sentiment's name or number; null of anything else."""
    table = F.create_map(*(F.lit(x) for kv in SENTIMENT_WORDS.items() for x in kv))
    return F.element_at(table, F.lower(F.trim(_c(c))))


def sentiment_name(c: Column | str) -> Column:
    """Name of a code 0..2, else null."""
    return F.get(F.array(*map(F.lit, SENTIMENTS)), _c(c))


def json_like(c: Column | str) -> Column:
    """A list literal with single quotes as JSON text; quotes inside words stay."""
    x = F.regexp_replace(_c(c), r"'(?=\s*[,\]:}])|(?<=[\[,:{]|[\[,:{]\s)'", '"')
    return F.regexp_replace(x, r"\b(nan|NaN|None)\b", "null")


def parse(c: Column | str) -> Column:
    """Triplets of JSON text or a list literal: lists of three, or records with known names.

    Entries with another shape, a blank aspect or opinion, or a sentiment outside 0..2 are dropped;
    text that is no list gives an empty array. Records of sentiment 0 are kept.
    """
    x = F.coalesce(_c(c), F.lit(""))
    fixed = json_like(x)
    lists = F.coalesce(F.from_json(x, "array<array<string>>"), F.from_json(fixed, "array<array<string>>"))
    records = F.coalesce(F.from_json(x, _ALIASES), F.from_json(fixed, _ALIASES))
    from_list = F.transform(
        F.filter(lists, lambda t: F.size(t) == 3),
        lambda t: F.struct(F.get(t, F.lit(0)).alias("aspect"), F.get(t, F.lit(1)).alias("opinion"), F.get(t, F.lit(2)).try_cast("int").alias("sentiment")),
    )
    from_record = F.transform(
        records,
        lambda t: F.struct(
            F.coalesce(t["aspect_phrase"], t["aspect"], t["a"]).alias("aspect"),
            F.coalesce(t["opinion_phrase"], t["opinion"], t["o"]).alias("opinion"),
            F.coalesce(t["sentiment_int"].try_cast("int"), t["sentiment"].try_cast("int"), t["s"].try_cast("int")).alias("sentiment"),
        ),
    )
    empty = F.array().cast(TRIPLETS)
    return F.filter(F.coalesce(from_list.cast(TRIPLETS), from_record.cast(TRIPLETS), empty), is_valid)


def is_valid(t: Column) -> Column:
    return F.coalesce((F.trim(t["aspect"]) != "") & (F.trim(t["opinion"]) != "") & t["sentiment"].isin(0, 1, 2), F.lit(False))


def parse_pipes(c: Column | str) -> Column:
    """One triplet 'aspect|opinion|sentiment' as a struct, null unless it has exactly three good parts."""
    parts = F.split(F.trim(_c(c)), r"\|")
    t = F.struct(F.trim(F.get(parts, F.lit(0))).alias("aspect"), F.trim(F.get(parts, F.lit(1))).alias("opinion"), sentiment_code(F.get(parts, F.lit(2))).alias("sentiment"))
    return F.when((F.size(parts) == 3) & is_valid(t), t)


def serialize(c: Column | str) -> Column:
    """'(aspect, opinion, sentiment name) ; ...', or 'none'."""
    ts = _c(c)
    each = F.transform(ts, lambda t: F.concat(F.lit("("), t["aspect"], F.lit(", "), t["opinion"], F.lit(", "), sentiment_name(t["sentiment"]), F.lit(")")))
    return F.when(F.size(ts) > 0, F.array_join(each, " ; ")).otherwise("none")


def deserialize(c: Column | str) -> Column:
    """The triplets of serialize's text; anything else in it is passed over."""
    pattern = r"\(([^,()]+),([^,()]+),([^,()]+)\)"
    a, o, s = (F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    zipped = F.arrays_zip(a.alias("a"), o.alias("o"), s.alias("s"))
    return F.filter(F.transform(zipped, lambda z: F.struct(F.trim(z["a"]).alias("aspect"), F.trim(z["o"]).alias("opinion"), sentiment_code(z["s"]).alias("sentiment"))), is_valid)


def distinct_aspects(c: Column | str) -> Column:
    """Aspects in order of first occurrence, once each."""
    return F.array_distinct(F.transform(F.filter(_c(c), lambda t: F.trim(t["aspect"]) != ""), lambda t: F.trim(t["aspect"])))


def flatten(df: DataFrame, triplets: str) -> DataFrame:
    """One row per triplet, with its fields and place."""
    exploded = df.select(*(c for c in df.columns if c != triplets), F.posexplode(triplets).alias("triplet_no", "_t"))
    return exploded.select("*", "_t.aspect", "_t.opinion", "_t.sentiment").drop("_t")


def stats(df: DataFrame, triplets: str, by: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    """Rows with, without and with several triplets, totals, mean, greatest number; by group, with a total row on rollup."""
    n = F.coalesce(F.size(triplets), F.lit(0))
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("n_rows"),
        F.count_if(n > 0).alias("n_with"),
        F.count_if(n == 0).alias("n_without"),
        F.count_if(n > 1).alias("n_multi"),
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_triplets"),
        F.round(F.avg(n), 6).alias("mean_triplets"),
        F.max(n).cast("bigint").alias("most_triplets"),
    )


def aspect_matrix(flat: DataFrame) -> DataFrame:
    """Per aspect in lower case: counts by sentiment, the total and the dominant sentiment (the lower on ties)."""
    counts = flat.groupBy(F.lower(F.trim("aspect")).alias("aspect")).agg(*(F.count_if(F.col("sentiment") == k).alias(name) for k, name in enumerate(SENTIMENTS)))
    best = F.greatest(*SENTIMENTS)
    dominant = F.when(F.col("negative") == best, "negative").when(F.col("neutral") == best, "neutral").otherwise("positive")
    return counts.withColumns({"total": F.col("negative") + F.col("neutral") + F.col("positive"), "dominant": dominant})


def majority(sentiments: Column | str, default: int = 2) -> Column:
    """The most frequent code of an array, the lowest on ties, default where it is empty."""
    s = F.coalesce(_c(sentiments), F.array().cast("array<int>"))
    counts = F.transform(F.array(*map(F.lit, (0, 1, 2))), lambda k: F.struct(F.size(F.filter(s, lambda x: x == k)).alias("n"), (-k).alias("k")))
    return F.when(F.size(s) == 0, default).otherwise(-F.array_max(counts)["k"])


def parse_response(c: Column | str) -> Column:
    """Triplets of a model's answer: code fences and talk around the list are dropped; no list gives an empty array."""
    body = F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?s)(\[.*\])", 1)
    return parse(body)


def with_aspect(triplets: Column | str, aspect: str) -> Column:
    """Whether a row has a triplet of the aspect, case apart."""
    return F.exists(_c(triplets), lambda t: F.lower(F.trim(t["aspect"])) == aspect.lower())


def with_sentiment(triplets: Column | str, code: int) -> Column:
    return F.exists(_c(triplets), lambda t: t["sentiment"] == code)
