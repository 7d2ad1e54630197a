"""Similarity clusters by power-iteration spectral clustering on sparse affinities (problem 7).

The affinities are the links of the set join, normalised by row. Several random start vectors are
iterated with them at once: v' = (1 + m) M v - m v_before, where M is the walk along affinities with
a little staying in place, and m a momentum that speeds up the iteration. The vectors that M leaves
as they are take one value on each group of rows joined by affinities, so rows of a group draw
together, each group at a place of its own, and all else dies out.

Rows of small groups mostly stand in one task: rows are sent to tasks by a hint of the set join, and where
no affinity of a row and of all it is joined to leaves the task, all steps are made there at once. All
other rows are iterated by joins across tasks. Where a row is iterated decides nothing but the cost.

K-means then clusters the embedding alone: centres are the means of occupied cells of a fine grid,
centres that lie together become one, rows belong to the centre nearest to them, whatever it is
that joins them. No number of clusters need be given.

Affinities are used once more to tell which clusters are finished: those that no affinity leaves
and whose rows lie within a fraction of a cell. The rows of the others, whose groups are long drawn
out, become the next level: rows join the nearest of the neighbours picked by a hash, each such
bundle is one row with the summed affinities, and is iterated and clustered in the same way.

With vectors of d dimensions and cells of width w, two of K groups come to lie together with a
probability of about (2w)^d K^2 / 2; the number of vectors is chosen to keep it below one in a thousand.

Vectors, affinities and labels are distributed tables. A row with many affinities is spread over as many
tasks as it needs; sums are combined map-side. Vectors are written to the shared folder every few steps.

Defined results: rows without links are in no cluster; repeated links and links of a row to
itself change nothing; empty links give no clusters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinark.runtime import cut, lookup_join

MAX_LEVELS = 40
#: Width of the grid's cells; start values lie between 0 and 1.
CELL = 1e-6
#: Share of a step that stays in place, and the momentum that is best for it.
STAY = 0.2
_RADIUS = (1 - STAY) / (1 + STAY)
_FALL = (1 - math.sqrt(1 - _RADIUS * _RADIUS)) / _RADIUS
MOMENTUM = _FALL * _FALL
#: What isn't common to a group has fallen to CELL / 100 after so many steps, where it falls as the momentum is made for.
STEPS = math.ceil(math.log(100 / CELL) / -math.log(_FALL)) + 4
#: Steps between two writes of the vectors.
CHUNK = 8
#: Affinities of one row that one task takes.
HOT_EDGES = 200_000
#: Affinities that one task iterates by itself, on average, and the steps it makes before it leaves its rows to further levels.
PART_EDGES = 100_000
LOCAL_STEPS = 2_000


def vectors_for(nodes: int) -> int:
    """Vectors that keep groups apart: (2w)^d K^2 / 2 below one in a thousand for as many groups as there are rows."""
    return max(3, math.ceil(math.log(500 * max(nodes, 1) ** 2) / -math.log(2 * CELL)))


def affinities(links: DataFrame) -> DataFrame:
    """(src, salt, dst, p, own): both ways of each link (a, b, w), p normalised over dst, and a row for each node itself.

    salt spreads the rows of one src that has more than HOT_EDGES of them.
    """
    ways = links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w")
    both = ways.select("e.src", "e.dst", "w")
    mass = cut(both.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("mass"), F.ceil(F.count("*") / HOT_EDGES).alias("salts")), "mass")
    scaled = both.join(mass.select(F.col("node").alias("dst"), "mass"), "dst").select("src", "dst", (F.col("w") / F.col("mass")).alias("p"), F.lit(False).alias("own"))
    selves = mass.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("p"), F.lit(True).alias("own"))
    salted = lookup_join(scaled, mass.where("salts > 1").select(F.col("node").alias("src"), "salts"), ["src"], "left")
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(0)
    return salted.select("src", salt.cast("int").alias("salt"), "dst", "p", "own").unionByName(selves.withColumn("salt", F.lit(0)))


def _hot(edges: DataFrame) -> DataFrame | None:
    """(node, salts) of the rows whose affinities are spread, if any."""
    hot = edges.where("salt > 0").groupBy(F.col("src").alias("node")).agg((F.max("salt") + 1).alias("salts"))
    return cut(hot, "hot") if edges.where("salt > 0").limit(1).count() else None


def _along(edges: DataFrame, state: DataFrame, hot: DataFrame | None) -> DataFrame:
    """edges with the columns of their src in state (node, ...)."""
    if hot is None:
        return edges.join(state.hint("shuffle_hash"), edges.src == state.node)
    spread = lookup_join(state, hot, ["node"], "left").withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return edges.join(spread.hint("shuffle_hash"), (edges.src == spread.node) & (edges.salt == spread.at))


def _start(node: str, k: int, level: int, spread: float) -> F.Column:
    u = F.shiftrightunsigned(F.xxhash64(node, F.lit(k), F.lit(level)), 11).cast("double") / float(2**53)
    return F.lit(0.5) + (u - 0.5) * spread


def start_values(nodes: np.ndarray, k: int, spread: float) -> np.ndarray:
    """Random start values between 0 and 1 by node; constant ones for a spread of zero."""
    x = nodes.astype(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for mix, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mix)
    return 0.5 + ((x ^ (x >> np.uint64(31))) / 2.0**64 - 0.5) * spread


def iterate_here(src: np.ndarray, dst: np.ndarray, w: np.ndarray, vectors: int, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, vectors, leaves, leads): power iteration for the affinities one task holds.

    leaves: rows joined, directly or through others, to rows the task does not hold, or not settled; their vectors say nothing.
    leads: for these, the first row they are joined to in this task.
    """
    nodes, to = np.unique(dst, return_inverse=True)
    at = np.minimum(np.searchsorted(nodes, src), len(nodes) - 1)
    inside = nodes[at] == src
    leaves = np.zeros(len(nodes), bool)
    leaves[to[~inside]] = True
    a, b, w = at[inside], to[inside], w[inside]

    def spread_flag() -> None:
        while (more := ~leaves[a] & leaves[b]).any():
            leaves[a[more]] = True

    spread_flag()
    kept = ~leaves[b]
    a, b, w = a[kept], b[kept], w[kept]
    p = w / np.bincount(b, w, len(nodes))[b] / (1 + STAY)
    x = np.stack([start_values(nodes, k, spread) for k in range(vectors)])
    old, left = x, np.ones(len(nodes), bool)
    out = x.copy()
    for step in range(LOCAL_STEPS):
        m = MOMENTUM if step else 0.0
        new = np.stack([(1 + m) * (np.bincount(b, p * x[k, a], len(nodes)) + STAY / (1 + STAY) * x[k]) - m * old[k] for k in range(vectors)])
        x, old = new, x
        if step >= STEPS - 1 and (step - STEPS + 1) % 25 == 0:  # settled rows stop, with all they are joined to
            out[:, left] = x[:, left]
            rough = np.zeros(len(nodes), bool)
            rough[b[np.abs(x[:, a] - x[:, b]).max(0, initial=0.0) > CELL / 10_000]] = True
            while (more := ~rough[a] & rough[b]).any():
                rough[a[more]] = True
            left = rough
            on = rough[b]
            a, b, p = a[on], b[on], p[on]
            if not len(a):
                break
    leaves[np.concatenate([a, b])] = True
    spread_flag()
    a, b = at[inside], to[inside]
    a, b = a[leaves[b]], b[leaves[b]]
    leads = np.arange(len(nodes))
    while (leads[a] < leads[b]).any():
        np.minimum.at(leads, b, leads[a])
    return nodes, out, leaves, nodes[leads]


def embed(edges: DataFrame, hot: DataFrame | None, level: int, vectors: int, steps: int = STEPS, spread: float = 1.0) -> DataFrame:
    """(node, v0, v1, ...): the random start vectors after power iteration with momentum."""
    names = range(vectors)
    state = edges.where("own").select(F.col("src").alias("node"), *(_start("src", k, level, spread).alias(f"v{k}") for k in names), *(F.lit(0.0).alias(f"u{k}") for k in names))
    for step in range(steps):
        m = MOMENTUM if step else 0.0
        share = F.when(F.col("own"), STAY).otherwise(F.col("p")) * ((1 + m) / (1 + STAY))
        moved = _along(edges, state, hot)
        new = [F.sum(share * F.col(f"v{k}") - F.when(F.col("own"), m * F.col(f"u{k}")).otherwise(0.0)).alias(f"v{k}") for k in names]
        old = [F.sum(F.when(F.col("own"), F.col(f"v{k}")).otherwise(0.0)).alias(f"u{k}") for k in names]
        state = moved.groupBy(F.col("dst").alias("node")).agg(*new, *old)
        if step % CHUNK == CHUNK - 1 and step < steps - 1:
            state = cut(state, "vectors")
    return cut(state.select("node", *(f"v{k}" for k in names)), "space")


def _cells(names: list[str], level: int, aside: float = 0.0) -> list[F.Column]:
    """The grid cell of a place; the grid lies differently on each level."""
    return [F.floor(F.col(n) / CELL + (0.37 * (k + 1) * (level + 1)) % 1 + aside) for k, n in enumerate(names)]


def kmeans(space: DataFrame, level: int = 0) -> DataFrame:
    """(node, centre, off): the cluster of each row, named by its smallest row, and how far the row lies from the centre, in cells."""
    names = [c for c in space.columns if c != "node"]
    keys = [f"c{k}" for k in range(len(names))]
    in_cells = space.withColumns(dict(zip(keys, _cells(names, level))))
    centres = cut(in_cells.groupBy(*keys).agg(F.min("node").alias("first"), *(F.avg(n).alias(n) for n in names)), "centres")
    # centres near a wall of their cell may have others right behind it: those within a quarter of a cell are one
    near = [F.array_distinct(F.array(a, b)) for a, b in zip(_cells(names, level, -0.25), _cells(names, level, 0.25))]
    looks = centres.select("first", *names, *(x.alias(k) for x, k in zip(near, keys)))
    for k in keys:
        looks = looks.withColumn(k, F.explode(k))
    others = centres.select(*keys, F.col("first").alias("other"), *(F.col(n).alias(f"o{n}") for n in names))
    far = F.greatest(*(F.abs(F.col(n) - F.col(f"o{n}")) for n in names)) if len(names) > 1 else F.abs(F.col(names[0]) - F.col(f"o{names[0]}"))
    merged = looks.join(others, keys).where(far <= CELL / 4).groupBy("first").agg(F.min("other").alias("centre"), *(F.min_by(f"o{n}", "other").alias(f"o{n}") for n in names))
    centre_of = centres.select(*keys, "first").join(merged, "first")
    return in_cells.join(centre_of, keys).select("node", "centre", (far / CELL).alias("off"))


def _crossed(edges: DataFrame, hot: DataFrame | None, placed: DataFrame) -> DataFrame:
    """(centre) of the clusters that an affinity leaves."""
    seen = _along(edges, placed, hot).groupBy(F.col("dst").alias("node")).agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"), F.max(F.when(F.col("own"), F.col("centre"))).alias("centre"))
    return seen.where("lo <> hi").select("centre")


def _bundles(links: DataFrame, space: DataFrame, level: int) -> DataFrame:
    """(node, bundle): each row with the nearest of its neighbours whose hash is the least among their own neighbours; itself if it has none."""
    names = [c for c in space.columns if c != "node"]
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = links.select(F.explode(ways).alias("e")).select("e.src", "e.dst")
    rank = lambda c: F.xxhash64(c, F.lit(level))
    picked = both.groupBy("dst").agg(F.min(rank("src")).alias("least")).where(rank("dst") < F.col("least")).select(F.col("dst").alias("src"))
    at = space.select(F.col("node").alias("src"), *(F.col(n).alias(f"s{n}") for n in names))
    near = both.join(picked, "src").join(at, "src").join(space, F.col("dst") == F.col("node"))
    square = sum((F.col(n) - F.col(f"s{n}")) * (F.col(n) - F.col(f"s{n}")) for n in names)
    joined = near.groupBy("node").agg(F.min(F.struct(square.alias("far"), F.col("src"))).alias("m"))
    return space.select("node").join(joined, "node", "left").select("node", F.coalesce("m.src", "node").alias("bundle"))


def _in_parts(links: DataFrame, n_links: int, vectors: int, spread: float) -> tuple[DataFrame, DataFrame]:
    """(node, v0, v1, ...) of the rows iterated in one task, and the links (a, b, w) of all others; links (a, b, w, lead)."""
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = links.select(F.explode(ways).alias("e"), "w", "lead").select("e.src", "e.dst", "w", "lead")
    leads = cut(both.groupBy("dst").agg(F.min("lead").alias("lead"), F.count("*").alias("n")), "leads")
    # a lead with more than a task's share is spread by row; a row with too many affinities is left to the joins
    wide = leads.groupBy("lead").agg(F.sum("n").alias("n")).where(F.col("n") > 4 * PART_EDGES).select("lead", F.ceil(F.col("n") / PART_EDGES).alias("salts"))
    parts = math.ceil(2 * n_links / PART_EDGES)
    salted = lookup_join(leads, wide, ["lead"], "left")
    part = F.pmod(F.xxhash64("lead", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(0)), F.lit(parts))
    sent = both.drop("lead").join(salted.select("dst", F.when(F.col("n") > HOT_EDGES, -1).otherwise(part).cast("int").alias("part")), "dst")
    names = [f"v{k}" for k in range(vectors)]
    schema = "src long, dst long, w double, lead long, " + ", ".join(f"{n} double" for n in names)

    def run(table: pa.Table) -> pa.Table:
        src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
        nodes, found, leaves, leads = iterate_here(src, dst, w, vectors, spread)
        place = np.searchsorted(nodes, dst)
        out = leaves[place]  # each link comes from both its ends, with the lead of either
        n, settled = int(out.sum()), ~leaves
        no = int(settled.sum())
        columns = [src[out], dst[out], w[out], leads[place[out]]]
        rows = {c: pa.concat_arrays([pa.array(x), pa.nulls(no, pa.array(x).type)]) for c, x in zip(("src", "dst", "w", "lead"), columns)}
        rows["dst"] = np.concatenate([dst[out], nodes[settled]])
        return pa.table(rows | {v: pa.concat_arrays([pa.nulls(n, pa.float64()), pa.array(found[k, settled])]) for k, v in enumerate(names)})

    ran = cut(sent.where("part >= 0").select("part", "src", "dst", "w").groupBy("part").applyInArrow(run, schema), "iterated")
    left = ran.where("src is not null").select("src", "dst", "w", "lead").unionByName(sent.where("part < 0").select("src", "dst", "w", F.least("src", "dst").alias("lead")))
    left = left.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"), F.min("lead").alias("lead"))
    return ran.where("src is null").select(F.col("dst").alias("node"), *names), cut(left, "left")


def _space(links: DataFrame, level: int, steps: int, vectors: int, spread: float) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(node, v0, v1, ...) of all rows of the links, and the affinities (and hot rows) of those iterated by joins."""
    n, spaces = links.count(), []
    while n:  # what one task can't iterate is sent to fewer tasks, as long as that helps
        settled, links = _in_parts(links, n, vectors, spread)
        spaces.append(settled)
        before, n = n, links.count()
        if n > 0.8 * before:
            break
    edges = hot = None
    if n:
        edges = affinities(links)
        edges = edges.repartition(*(["src", "salt"] if edges.where("salt > 0").limit(1).count() else ["src"])).persist()
        hot = _hot(edges)
        spaces.append(embed(edges, hot, level, vectors, steps, spread))
    space = spaces[0]
    for more in spaces[1:]:
        space = space.unionByName(more)
    return space, edges, hot


def spectral_clusters(links: DataFrame, steps: int = STEPS, spread: float = 1.0) -> DataFrame:
    """(node, root): the cluster of every linked node, named by its smallest node.

    links (a, b, likeness, lead); lead is any hint at which rows belong together, and may be missing.
    spread is the range of the random start values; at zero the vectors are constant and all rows one cluster.
    """
    lead = F.col("lead") if "lead" in links.columns else F.least("a", "b")
    tidy = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("likeness").alias("w"), lead.alias("lead"))
    level = cut(tidy.groupBy("a", "b").agg(F.max("w").alias("w"), F.min("lead").alias("lead")), "level")
    n = level.count()
    if not n:
        return level.select(F.col("a").alias("node"), F.col("b").alias("root"))
    vectors = vectors_for(2 * n)
    rows = None  # (node, label): rows of unfinished clusters and the bundle they are in; none before the first level
    finished = []
    for depth in range(MAX_LEVELS):
        space, edges, hot = _space(level, depth, steps, vectors, spread)
        placed = cut(kmeans(space, depth), "placed")
        unfinished = placed.where("off > 0.1").select("centre")
        if edges is not None:
            unfinished = unfinished.unionByName(_crossed(edges, hot, placed))
        unfinished = cut(unfinished.distinct(), "unfinished")
        done = placed.join(unfinished, "centre", "left_anti").select(F.col("node").alias("label"), F.col("centre").alias("root"))
        finished.append(done.withColumnRenamed("label", "node") if rows is None else rows.join(done, "label").select("node", "root"))
        if edges is not None:
            edges.unpersist()
        if not unfinished.limit(1).count():
            break
        # the rest: bundles become the rows of the next level
        open_rows = cut(placed.join(unfinished, "centre", "left_semi").select("node"), "open")
        open_links = cut(level.join(open_rows.withColumnRenamed("node", "a"), "a").join(open_rows.withColumnRenamed("node", "b"), "b").select("a", "b", "w"), "open-links")
        to = cut(_bundles(open_links, space.join(open_rows, "node"), depth), "bundles")
        a, b = (to.select(F.col("node").alias(n), F.col("bundle").alias(f"{n}_to")) for n in ("a", "b"))
        crossed = open_links.join(a, "a").join(b, "b").where("a_to <> b_to")
        level = cut(crossed.groupBy(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).agg(F.sum("w").alias("w"), F.min(F.least("a_to", "b_to")).alias("lead")), "level")
        known = rows if rows is not None else to.select("node", F.col("node").alias("label"))
        rows = cut(known.join(to.select(F.col("node").alias("label"), "bundle"), "label").select("node", F.col("bundle").alias("label")), "rows")
        # a bundle that takes in all of its group has no affinities left: it is a cluster
        alone = rows.join(level.select(F.explode(F.array("a", "b")).alias("label")).distinct(), "label", "left_anti")
        finished.append(alone.select("node", F.col("label").alias("root")))
        if not level.limit(1).count():
            break
    else:
        raise RuntimeError("clusters did not settle")
    labels = finished[0]
    for f in finished[1:]:
        labels = labels.unionByName(f)
    if len(finished) == 1:
        return labels
    # bundles are named by any of their rows: clusters are named by their smallest
    labels = cut(labels.withColumnRenamed("root", "label"), "labels")
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("root")), "label").select("node", "root")


def with_copies(clusters: DataFrame, copies: DataFrame) -> DataFrame:
    """(row_id, root) of all rows in clusters of two rows or more; copies (row_id, rep)."""
    roots = clusters.select(F.col("node").alias("rep"), "root")
    copied = copies.join(roots, "rep", "left").select("row_id", F.coalesce("root", "rep").alias("root"))
    lone = copies.select("rep").distinct().join(roots, "rep", "left_anti").select(F.col("rep").alias("row_id"), F.col("rep").alias("root"))
    members = clusters.select(F.col("node").alias("row_id"), "root").unionByName(copied).unionByName(lone)
    # a copy may have a smaller id than the row that stands for it
    lowest = copied.unionByName(lone).groupBy("root").agg(F.min("row_id").alias("low"))
    return members.join(lowest, "root", "left").select("row_id", F.least("root", "low").alias("root"))


def typical_members(members: DataFrame, sets: DataFrame, top: int = 3) -> DataFrame:
    """(root, cluster_size, rank, row_id, affinity): each cluster's members of greatest mean overlap with all members.

    Affinity of a member is the mean, over all members, of shared words / own words. It is summed by
    word counts of the cluster, so no pair of members is made.
    """
    occurring = members.join(sets, "row_id").select("root", "row_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    occurring = cut(occurring, "cluster-words")
    counts = occurring.groupBy("root", "word").agg(F.count("*").alias("holders"))
    sizes = members.groupBy("root").agg(F.count("*").alias("cluster_size"))
    scored = occurring.join(counts, ["root", "word"]).groupBy("root", "row_id").agg(F.sum("holders").alias("shared"), F.first("n").alias("n"))
    scored = scored.join(sizes, "root").select("root", "cluster_size", "row_id", F.round(F.col("shared") / F.col("n") / F.col("cluster_size"), 6).alias("affinity"))
    # the rank limit is applied before the shuffle as well, so a huge cluster sends `top` rows a task
    order = Window.partitionBy("root").orderBy(F.desc("affinity"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("root", "cluster_size", "rank", "row_id", "affinity")
