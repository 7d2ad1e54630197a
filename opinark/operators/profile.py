"""Profiles of tables: counts, nulls, quantiles, histograms, keys, join coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long_form(df: DataFrame, columns: Sequence[str], hit: dict[str, Column], name: str) -> DataFrame:
    """(column, name, total, percent): all conditions counted in one pass, then unpivoted on the one result row."""
    total = F.count("*").alias("_total")
    row = df.agg(total, *(F.count_if(hit[c]).alias(c) for c in columns))
    long = row.select("_total", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in columns))).alias("s"))
    share = F.round(F.coalesce(F.try_divide(F.col("s.n") * F.lit(100.0), F.col("_total")), F.lit(0.0)), 6)
    return long.select(F.col("s.column").alias("column"), F.col("s.n").alias(name), F.col("_total").alias("total"), share.alias("percent"))


def null_profile(df: DataFrame) -> DataFrame:
    return _long_form(df, df.columns, {c: F.col(f"`{c}`").isNull() for c in df.columns}, "nulls")


def nan_profile(df: DataFrame) -> DataFrame:
    """Floating-point columns only."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return _long_form(df, names, {c: F.coalesce(F.isnan(f"`{c}`"), F.lit(False)) for c in names}, "nans")


def empty_list_profile(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return _long_form(df, names, {c: F.coalesce(F.size(f"`{c}`") == 0, F.lit(False)) for c in names}, "empty")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, stddev, lowest, highest), one pass."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("stddev"), F.min(v).alias("lowest"), F.max(v).alias("highest")))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """(quantile, value), interpolated."""
    row = df.agg(F.percentile(column, F.array(*map(F.lit, at))).alias("q"))
    return row.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("quantile"), F.round("value", 6).alias("value"))


def approx_quantiles(df: DataFrame, column: str, at: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """(quantile, value) by a mergeable sketch of fixed size: one pass, no sort."""
    row = df.agg(F.percentile_approx(column, F.array(*map(F.lit, at)), F.lit(accuracy)).alias("q"))
    return row.select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("quantile"), "value")


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket from 1, low, high, n): equal widths between least and greatest value, the last bucket closed."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = F.col(column).cast("double")
    placed = df.where(v.isNotNull()).crossJoin(F.broadcast(edges))
    width = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((v - F.col("lo")) / width) + 1, F.lit(buckets)))
    counted = placed.groupBy(bucket.cast("int").alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("bucket", F.round(F.col("lo") + (F.col("bucket") - 1) * width, 6).alias("low"), F.round(F.col("lo") + F.col("bucket") * width, 6).alias("high"), "n")


def bucketize(c: Column | str, splits: Sequence[float]) -> Column:
    """Number of the half-open bucket of c from 0, the last one closed; null outside."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c == splits[-1], len(splits) - 2)
    for k in range(len(splits) - 1):
        out = out.when((c >= splits[k]) & (c < splits[k + 1]), k)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(total, distinct_keys, is_unique)."""
    key = F.struct(*keys)
    return df.agg(F.count("*").alias("total"), F.count_distinct(key).alias("distinct_keys")).withColumn("is_unique", F.col("total") == F.col("distinct_keys"))


def singleton_share(df: DataFrame, key: str) -> DataFrame:
    """(n_keys, n_single, share): how many keys occur once."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") == 1).alias("n_single")).withColumn("share", F.round(F.try_divide(F.col("n_single") * F.lit(1.0), F.col("n_keys")), 6))


def join_coverage(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(matched, unmatched) rows of left; null keys match nothing. The right side is reduced to its keys first."""
    keys = right.select(on).where(F.col(on).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return left.select(on).join(keys, on, "left").agg(F.count("_hit").alias("matched"), F.count_if(F.col("_hit").isNull()).alias("unmatched"))


def json_field_paths(df: DataFrame, column: str) -> DataFrame:
    """(field, n): how often each path occurs in JSON text, members of lists under 'path__list_of'."""
    import json
    from collections import Counter
    from collections.abc import Iterator

    import pandas as pd

    def walk(value, prefix: str, seen: Counter) -> None:
        stack = [(value, prefix)]
        while stack:
            v, at = stack.pop()
            if isinstance(v, dict):
                for k, x in v.items():
                    path = f"{at}.{k}" if at else k
                    seen[path] += 1
                    stack.append((x, path))
            elif isinstance(v, list):
                stack.extend((x, f"{at}__list_of") for x in v)

    def frame(seen: Counter) -> pd.DataFrame:
        return pd.DataFrame({"field": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                try:
                    walk(json.loads(t), "", seen)
                except (ValueError, TypeError):
                    continue
            if len(seen) > 100_000:
                yield frame(seen)
                seen = Counter()
        if seen:
            yield frame(seen)

    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("t")).mapInPandas(count, "field string, n long").groupBy("field").agg(F.sum("n").alias("n"))


def time_parts(ms: Column | str) -> dict[str, Column]:
    """ts, day, year, month and day of month of epoch milliseconds; 0 and seconds are no time in milliseconds."""
    c = F.col(ms) if isinstance(ms, str) else ms
    ms_clean = F.when(c < 1, None).when(c < 100_000_000_000, c * 1000).otherwise(c)
    ts = F.timestamp_millis(ms_clean)
    return {"ts": ts, "day": F.to_date(ts), "year": F.year(ts), "month": F.month(ts), "day_of_month": F.dayofmonth(ts)}
