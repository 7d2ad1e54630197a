"""Records that stand, the same or almost the same, in two splits (problem 5).

Winnowing: each record's words are hashed in runs of K words by a rolling hash, and of every W
consecutive hashes the least is selected. Two records that share a run of K + W - 1 words always
select a common hash there. Hashes are ordered by how many records hold them, rarest first, so
stock phrases are selected only where a window holds nothing rarer; the counts of the most
frequent hashes are exact and broadcast in a table of fixed size, all others count as rare.

Runs alone don't find all pairs of a given likeness: a few changes, or clauses in another order, can
leave no common run. So sequences also meet by the rarest few words of their word sets (the prefix
words of the set join), or by two, three ... of them where many sequences hold a word. Any two word
sets of the likeness share such a word.

Selected hashes are joined across splits on distinct word sequences, to which copies rejoin at the
end. With each hash go two 64-bit sketches of the record's word set and its size: pairs whose sketches
differ in more bits than the likeness allows words are dropped inside the join, so that almost only
true pairs leave it. The likeness of the word sets then decides exactly; for pairs that have it the seeds are
chained collinearly, extended by alignment (longest common subsequence of words between them), and
reported as coverage; pairs that met by words only are aligned as a whole. All pairs of the likeness are found.

Defined results: null texts, texts under min_words words, and rows of other or null splits are in
no pair; repeated rows each give their pairs; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.llm.leakage import run_hashes
from opinark.llm.setjoin import Coder, Likeness, _row_order, frequent_words, group_rows, word_sets
from opinark.llm.text import words
from opinark.runtime import cut

RUN_WORDS = 4
WINDOW = 3
#: Sequences that would meet by a word of more sequences meet by several words.
GROUP_ROWS = 500
TOP_HASHES = 60_000


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


class _Batch:
    """The words of a batch's sequences one after the other, as hashes; places are those of the whole row of words."""

    def __init__(self, seqs: Sequence[str], seen: _Words, k: int) -> None:
        tokens = [s.split(" ") for s in seqs]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.array([seen[w] for t in tokens for w in t], np.uint64)
        hashes = run_hashes(self.words, k).view(np.int64)
        self.runs = np.maximum(self.sizes - k + 1, 0)  # of each sequence
        self.owner = np.repeat(np.arange(len(tokens)), self.runs)
        first = np.cumsum(self.runs) - self.runs
        self.place = np.arange(len(self.owner)) - first[self.owner]
        self.hashes = hashes[self.starts[self.owner] + self.place] if len(self.owner) else np.array([], np.int64)

    def sketches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of different words of each sequence, and two 64-bit sketches of the set."""
        seq = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort((self.words, seq))
        w, q = self.words[order], seq[order]
        new = np.append(True, (w[1:] != w[:-1]) | (q[1:] != q[:-1])) if len(w) else np.array([], bool)
        return np.bincount(q[new], minlength=len(self.sizes)), *(np.bitwise_or.reduceat(x, self.starts).view(np.int64) for x in word_bits(self.words))


def word_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of 64 bits for each word hash, in each of two sketches."""
    one = np.uint64(1)
    return one << (hashes & np.uint64(63)), one << (hashes >> np.uint64(17) & np.uint64(63))


def winnow(owner: np.ndarray, place: np.ndarray, runs: np.ndarray, hashes: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Which runs are selected: in every window of a sequence the least by order, then by hash, the last of equal ones.

    owner, place, hashes, order: of each run, sequence by sequence; runs: how many each sequence has. A sequence with
    fewer runs than a window is one window.
    """
    if not len(hashes):
        return np.array([], np.int64)
    rank = np.empty(len(hashes), np.int64)
    sorted_at = np.lexsort((hashes, order))
    o, h = order[sorted_at], hashes[sorted_at]
    rank[sorted_at] = np.cumsum(np.append(False, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
    key = rank << 31 | (1 << 31) - 1 - place
    left = runs[owner] - place  # runs from here to the end of the sequence
    best, at = key.copy(), np.arange(len(key))
    for step in range(1, window):
        nxt = np.minimum(np.arange(len(key)) + step, len(key) - 1)
        less = (left > step) & (key[nxt] < best)
        best[less], at[less] = key[nxt][less], nxt[less]
    begins = (left >= window) | (place == 0)
    return np.unique(at[begins])


def word_sequences(rows: DataFrame, row_id: str, text: str, side: F.Column, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(seq_id, side, seq) for each distinct word sequence of a side, and (row_id, side, seq_id) of all its rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [words(t) for t in pdf["t"]]
            keep = [len(w) >= min_words for w in found]
            pdf = pdf[keep]
            seqs = [" ".join(w) for w, k in zip(found, keep) if k]
            yield pd.DataFrame({"row_id": pdf["row_id"], "side": pdf["side"], "seq": seqs})

    source = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("t"), side.alias("side")).where("t is not null and side is not null")
    read_rows = cut(source.mapInPandas(read, "row_id long, side int, seq string"), "sequences")
    # hot copies collapse map-side; the smallest row names the sequence
    seqs = cut(read_rows.groupBy("side", "seq").agg(F.min("row_id").alias("seq_id")), "distinct-sequences")
    members = read_rows.join(seqs, ["side", "seq"]).select("row_id", "side", "seq_id")
    return seqs, members


def fingerprints(seqs: DataFrame, k: int = RUN_WORDS, window: int = WINDOW) -> DataFrame:
    """(side, seq_id, hash, place, n, sketch, sketch2): the selected hashes and where their runs begin; size and sketches of the word set."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Words()
        for pdf in batches:
            got = _Batch(pdf["seq"], seen, k)
            pairs = np.unique(np.stack([got.hashes, got.owner]), axis=1)[0] if len(got.hashes) else got.hashes
            values, n = np.unique(pairs, return_counts=True)
            yield pd.DataFrame({"hash": values.astype(np.int64), "n": n.astype(np.int64)})

    counted = seqs.select("seq").mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "hash").limit(TOP_HASHES).toArrow()
    hashes, n = (top.column(c).to_numpy().astype(np.int64) for c in ("hash", "n"))
    by_hash = np.argsort(hashes)
    shared = seqs.sparkSession.sparkContext.broadcast((hashes[by_hash], n[by_hash]))

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        seen = _Words()
        for pdf in batches:
            if not len(pdf):
                continue
            got = _Batch(pdf["seq"], seen, k)
            order = np.ones(len(got.hashes), np.int64)
            if len(known) and len(order):
                at = np.minimum(np.searchsorted(known, got.hashes), len(known) - 1)
                order = np.where(known[at] == got.hashes, counts[at], 1)
            picked = winnow(got.owner, got.place, got.runs, got.hashes, order, window)
            own = got.owner[picked]
            size, a, b = got.sketches()
            columns = {"side": pdf["side"].to_numpy()[own], "seq_id": pdf["seq_id"].to_numpy()[own], "hash": got.hashes[picked], "place": got.place[picked], "n": size[own], "sketch": a[own], "sketch2": b[own]}
            types = {"side": "int32", "seq_id": "int64", "hash": "int64", "place": "int32", "n": "int32", "sketch": "int64", "sketch2": "int64"}
            yield pd.DataFrame(columns).astype(types)

    return seqs.select("side", "seq_id", "seq").mapInPandas(select, "side int, seq_id long, hash long, place int, n int, sketch long, sketch2 long")


def seed_pairs(prints: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(a, b, seeds): pairs of sequences of sides 0 and 1 with a common selected hash, and where it stands.

    Only pairs whose sizes and sketches allow a likeness of num/den.
    """
    left = prints.where("side = 0").select("hash", F.col("seq_id").alias("a"), F.col("place").alias("pa"), F.col("n").alias("na"), F.col("sketch").alias("ka"), F.col("sketch2").alias("la"))
    right = prints.where("side = 1").select("hash", F.col("seq_id").alias("b"), F.col("place").alias("pb"), F.col("n").alias("nb"), F.col("sketch").alias("kb"), F.col("sketch2").alias("lb"))
    # the largest symmetric difference that two sets of these sizes may have; equal bits never count against a pair
    most = F.expr(f"(na + nb) - 2 * ((({num} * (na + nb)) + {num + den - 1}) div {num + den})")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most
    both = left.join(right, "hash").where(near("ka", "kb") & near("la", "lb"))
    return both.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("pa", "pb"))).alias("seeds"))


def prefix_keys(seqs: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(side, seq_id, hash, depth, place, n, sketch, sketch2): the groups in which each sequence meets all others of likeness num/den.

    place: where the last of the group's depth words stands among the n words of the set, rarest first.
    """
    sets = cut(word_sets(seqs.withColumn("side", F.col("side").cast("string")), "seq_id", "seq", min_words=1, keep="side"), "sequence-words")
    shared = seqs.sparkSession.sparkContext.broadcast(frequent_words(sets))
    like = Likeness(num, den)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            lens = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            starts = np.cumsum(lens) - lens
            flat = lists.flatten().to_numpy()
            sketches = [np.bitwise_or.reduceat(x, starts).view(np.int64) for x in word_bits(flat.view(np.uint64))]
            codes = coder.encode(flat)
            rec, key, pos, depth = group_rows(starts, lens, codes[_row_order(codes, lens)], coder, like, GROUP_ROWS)
            side, ids = (batch.column(i).take(pa.array(rec)) for i in (0, 1))
            ints = [pa.array(x.astype(np.int32)) for x in (depth, pos, lens[rec])]
            yield pa.RecordBatch.from_arrays([side, ids, pa.array(key.view(np.int64)), *ints, *(pa.array(x[rec]) for x in sketches)], names=["side", "seq_id", "hash", "depth", "place", "n", "sketch", "sketch2"])

    found = sets.mapInArrow(keys, "side string, seq_id long, hash long, depth int, place int, n int, sketch long, sketch2 long")
    return found.withColumn("side", F.col("side").cast("int"))


def prefix_pairs(keys: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(a, b): pairs of sequences of sides 0 and 1 in a common group whose sizes, places and sketches allow a likeness of num/den."""
    left = keys.where("side = 0").select("hash", "depth", F.col("seq_id").alias("a"), F.col("place").alias("pa"), F.col("n").alias("na"), F.col("sketch").alias("ka"), F.col("sketch2").alias("la"))
    right = keys.where("side = 1").select("hash", "depth", F.col("seq_id").alias("b"), F.col("place").alias("pb"), F.col("n").alias("nb"), F.col("sketch").alias("kb"), F.col("sketch2").alias("lb"))
    needed = f"(({num} * (na + nb) + {num + den - 1}) div {num + den})"
    # in the group of the rarest words two sets share, what they share besides stands after these words
    allowed = F.expr(f"depth + least(na - pa, nb - pb) - 1 >= {needed} and bit_count(ka ^ kb) <= na + nb - 2 * {needed} and bit_count(la ^ lb) <= na + nb - 2 * {needed}")
    return left.join(right, ["hash", "depth"]).where(allowed).select("a", "b").distinct()


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain of seeds: places that increase in both records."""
    seeds = sorted(seeds)
    best: list[tuple[int, int]] = []
    length, back = [1] * len(seeds), [-1] * len(seeds)
    for i, (x, y) in enumerate(seeds):
        for j in range(i):
            if seeds[j][0] < x and seeds[j][1] < y and length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
    i = max(range(len(seeds)), key=length.__getitem__, default=-1)
    while i >= 0:
        best.append(seeds[i])
        i = back[i]
    return best[::-1]


def _common(a: list[str], b: list[str]) -> int:
    """Words of the longest common subsequence: one row of the table at a time, as the bits of one number."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        if x in places:
            hit = row & places[x]
            row = (row + hit | row - hit) & whole
    return len(b) - row.bit_count()


def aligned_words(a: list[str], b: list[str], seeds: list[tuple[int, int]], k: int) -> int:
    """Words of a aligned with b: the chained seeds, and alignments of the stretches between them."""
    total, x, y = 0, 0, 0
    for pa, pb in chain(seeds):
        if pa < x or pb < y:  # it overlaps the seed before: only its new words count
            step = max(x - pa, y - pb)
            if step >= k:
                continue
            total += k - step
        else:
            total += _common(a[x:pa], b[y:pb]) + k
        x, y = pa + k, pb + k
    return total + _common(a[x:], b[y:])


def overlaps(seqs: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(a, b, likeness, coverage): sequence pairs of sides 0 and 1 with likeness num/den or more.

    coverage is the share of b's words aligned with a.
    """
    by_runs = seed_pairs(cut(fingerprints(seqs), "fingerprints"), num, den)
    by_words = prefix_pairs(cut(prefix_keys(seqs, num, den), "prefix-keys"), num, den)
    no_seeds = F.expr("cast(array() as array<struct<pa: int, pb: int>>)")
    pairs = by_runs.select("a", "b", "seeds", F.lit(RUN_WORDS).alias("k")).unionByName(by_words.select("a", "b", no_seeds.alias("seeds"), F.lit(0).alias("k")))
    pairs = pairs.groupBy("a", "b").agg(F.max_by(F.struct("seeds", "k"), "k").alias("s")).select("a", "b", "s.seeds", "s.k")
    texts = seqs.select("side", "seq_id", "seq")
    left = texts.where("side = 0").select(F.col("seq_id").alias("a"), F.col("seq").alias("sa"))
    right = texts.where("side = 1").select(F.col("seq_id").alias("b"), F.col("seq").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    # word sets are compared before any row goes to Python
    xa, xb = F.array_distinct(F.split("sa", " ")), F.array_distinct(F.split("sb", " "))
    inter = F.size(F.array_intersect(xa, xb))
    alike = joined.withColumns({"inter": inter, "total": F.size(xa) + F.size(xb)}).where(F.col("inter") * (num + den) >= F.col("total") * num)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b, seeds, k, sa, sb, inter, total in zip(*(pdf[c] for c in ("a", "b", "seeds", "k", "sa", "sb", "inter", "total"))):
                wb = sb.split(" ")
                got = aligned_words(sa.split(" "), wb, [(x["pa"], x["pb"]) for x in seeds], k)
                rows.append((a, b, inter / (total - inter), got / len(wb)))
            yield pd.DataFrame(rows, columns=["a", "b", "likeness", "coverage"])

    return alike.select("a", "b", "seeds", "k", "sa", "sb", "inter", "total").mapInPandas(align, "a long, b long, likeness double, coverage double")
