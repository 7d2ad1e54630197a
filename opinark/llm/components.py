"""Connected groups by hash-to-min, and splits that keep groups together (problem 6).

Hash-to-min: every node keeps a cluster, at first itself and its neighbours. In each round a node
sends its whole cluster to the cluster's smallest node, and that smallest node to the others. The
number of rounds is logarithmic in practice. Clusters are rows (node, member), never collected
lists; those of a node with very many members stay where they are and get its minimum by broadcast.

Splits: components are placed by weighted rendezvous hashing. Those too large for hashing to even
out are placed one by one into the split that lacks most; at most 1 / large_share components can
be so large, so that list is bounded. Hashing then fills up what the splits still lack.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.runtime import cut, discard, hot_join

MAX_ROUNDS = 100


def star_edges(pairs: DataFrame, node: str, through: str) -> DataFrame:
    """(a, b): each node with the smallest node it shares a value of `through` with, a < b.

    One edge per distinct (value, node), however many nodes share a value.
    """
    distinct = cut(pairs.where(F.col(node).isNotNull() & F.col(through).isNotNull()).select(F.col(node).alias("b"), F.col(through).alias("v")).distinct(), "values")
    lowest = distinct.groupBy("v").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("v", "a", "n")
    return hot_join(distinct, lowest, "v", "n").where("a < b").select("a", "b").distinct()


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.select(F.col("a").alias("node"), F.col("a").alias("member"))
    clusters = cut(nodes.unionByName(both.select(F.col("a").alias("node"), F.col("b").alias("member"))).distinct(), "clusters")
    most = None
    for _ in range(MAX_ROUNDS):
        low = clusters.groupBy("node").agg(F.min("member").alias("low"), F.count("*").alias("n"))
        sent = hot_join(clusters, low, "node", "n", most)
        to_low = sent.select(F.col("low").alias("node"), "member")
        to_rest = sent.select(F.col("member").alias("node"), F.col("low").alias("member"))
        new = cut(to_low.unionByName(to_rest).distinct(), "clusters")
        # stable when every cluster is {root} or that of the root itself
        low_now = new.groupBy("node").agg(F.min("member").alias("low"), F.count("*").alias("n"))
        most, unstable = low_now.agg(F.max("n"), F.count_if((F.col("low") != F.col("node")) & (F.col("n") > 1))).first()
        discard(clusters)
        clusters = new
        if not unstable:
            break
    else:
        raise RuntimeError("hash-to-min did not settle")
    return clusters.groupBy("node").agg(F.min("member").alias("root"))


def _rendezvous(weights: dict[str, float], seed: int) -> F.Column:
    """The split of greatest weighted rendezvous score for a root; a change of weights moves few roots."""
    scores = []
    for name, weight in weights.items():
        if weight > 0:
            h = F.xxhash64("root", F.lit(f"{seed}:{name}"))
            u = (F.shiftrightunsigned(h, 11).cast("double") + 1) / F.lit(float(2**53 + 1))
            scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(name).alias("split")))
    return scores[0]["split"] if len(scores) == 1 else F.greatest(*scores)["split"]


def assign_splits(sizes: DataFrame, targets: list[tuple[str, float]], seed: int = 42, large_share: float = 0.0005, passes: int = 6) -> DataFrame:
    """sizes (root, n) with the split of each component.

    targets: (split name, proportion), proportions above zero; they are taken relative to their sum.
    The weights of the hashing are tuned in a few passes over the sizes, until the splits' row
    counts meet what the large components leave to fill.
    """
    total_w = sum(p for _, p in targets)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lack = {name: p / total_w * total for name, p in targets}
    bound = max(1, math.ceil(total * large_share))
    large = sizes.where(F.col("n") >= bound).orderBy(F.desc("n"), "root").limit(math.ceil(1 / large_share) + 1).collect()
    placed = []
    for r in large:
        best = max(lack, key=lambda s: (lack[s], s))
        placed.append((r["root"], best))
        lack[best] -= r["n"]
    left = {s: max(v, 0.0) for s, v in lack.items()}
    if not sum(left.values()):
        left = dict(targets)
    small = sizes.where(F.col("n") < bound) if placed else sizes
    weights, chosen, least = dict(left), dict(left), math.inf
    for _ in range(passes if total else 0):
        got = {r["split"]: r["n"] for r in small.groupBy(_rendezvous(weights, seed).alias("split")).agg(F.sum("n").alias("n")).collect()}
        off = max(abs(got.get(s, 0) - v) for s, v in left.items())
        if off < least:
            chosen, least = dict(weights), off
        if off <= 0.0002 * total:
            break
        weights = {s: w * min(2.0, max(0.5, left[s] / got[s])) if got.get(s) and left[s] else w for s, w in weights.items()}
    pick = _rendezvous(chosen, seed)
    if not placed:
        return sizes.withColumn("split", pick)
    fixed = sizes.sparkSession.createDataFrame(placed, "root string, fixed string")  # 1 / large_share rows at most
    return sizes.join(F.broadcast(fixed), "root", "left").select(*sizes.columns, F.coalesce("fixed", pick).alias("split"))
