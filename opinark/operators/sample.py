"""Samples and splits that come out the same on every layout: order is by hash of key and seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """A text to order by, as good as random: md5 of key and seed."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def bernoulli(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Each row with probability `share`, by its key; no shuffle."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(min(share, 1.0) * 1_000_000))


def exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if fewer): a top-n by hash, so each task passes on n rows at most."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group. The rank limit also applies before the shuffle."""
    order = Window.partitionBy(group).orderBy(hash_order(key, seed), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def stratified_split(df: DataFrame, strata: Sequence[str], key: str, shares: Sequence[tuple[str, float]], seed: int = 42, into: str = "split") -> DataFrame:
    """A split per row so that each stratum is divided in the given shares, exact to one row.

    Strata are ranked by hash without moving a stratum to one task: rows are counted in 4096 hash
    ranges per stratum, ranks are offset plus rank within the small range.
    """
    h = hash_order(key, seed)
    ranged = df.withColumn("_h", h).withColumn("_range", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = ranged.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*strata))).drop("_n")
    offsets = offsets.select(*(F.col(c).alias(f"_o_{c}") for c in (*strata, "_range")), "_before", "_total")
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*strata, "_range")]
    placed = ranged.join(offsets, same).drop(*(f"_o_{c}" for c in (*strata, "_range")))
    inner = Window.partitionBy(*strata, "_range").orderBy("_h", key)
    rank = F.col("_before") + F.row_number().over(inner) - 1
    label = F.lit(shares[-1][0])
    for name, share in reversed(list(_upper(shares))[:-1]):
        label = F.when(rank < F.round(F.col("_total") * share), name).otherwise(label)
    return placed.withColumn(into, label).drop("_h", "_range", "_before", "_total")


def split_or_plain(df: DataFrame, strata: Sequence[str], key: str, shares: Sequence[tuple[str, float]], seed: int = 42, into: str = "split") -> DataFrame:
    """stratified_split, or the same split without strata where one of them has fewer than two rows."""
    small = df.groupBy(*strata).agg(F.count("*").alias("_n")).where("_n < 2").limit(1).count()
    return stratified_split(df, [] if small else strata, key, shares, seed, into)


def _upper(shares: Sequence[tuple[str, float]]):
    at = 0.0
    for name, share in shares:
        at += share
        yield name, at


def upsample(df: DataFrame, which: Column, times: int) -> DataFrame:
    """Rows for which `which` holds repeated `times` times, with copy_no from 1; others once."""
    n = F.when(F.coalesce(which, F.lit(False)), times).otherwise(1)
    return df.select("*", F.explode(F.sequence(F.lit(1), n)).alias("copy_no"))


def leak_free(train: DataFrame, test: DataFrame, text: str, normalize: bool = True) -> DataFrame:
    """Train rows whose text is not among the test texts, trimmed and in lower case if normalize. Null texts stay."""
    key = (lambda c: F.lower(F.trim(c))) if normalize else (lambda c: c)
    held = test.where(F.col(text).isNotNull()).select(key(F.col(text)).alias("_k")).distinct()
    return train.withColumn("_k", key(F.col(text))).join(held, "_k", "left_anti").drop("_k")
