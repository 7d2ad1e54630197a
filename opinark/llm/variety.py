"""A varied subset of given size per source (problem 3).

Concave feature coverage: features are words, weighted by the logarithm of how many rows hold
them, and a subset is worth the weighted sum of square roots of its feature masses. A further row
with words the subset has already adds little, so stock phrases and groups of look-alikes do not
fill it up.

Distributed descending-threshold rounds: in each round every task adds rows whose marginal gain,
over the subset so far and what it added itself, is at least the threshold; what the tasks added
is merged in a tree by the same rule; then the threshold falls. A task hands on at most the number
of rows still wanted, whatever its input, so the driver sees no more than the subset itself.

Defined results: null and wordless texts, and rows of sources without target, are not chosen; a
row whose words equal those of a chosen row is not chosen; a source with fewer different rows than
wanted gives them all; ties go to the smaller id.

Every word is a feature with its exact weight. The TOP_WORDS most frequent words have a broadcast
table; where there are more, the counts of the others are joined to the rows that hold them and
travel with these rows, and only masses of words in chosen rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.llm.setjoin import Coder, frequent_words, word_counts, word_sets
from opinark.runtime import cut, lookup_join, name_key

TOP_WORDS = 60_000
MERGE_WAYS = 16
#: codes: a row's words, those beyond the frequent ones first, as negative hashes; rare: how many rows hold each of these.
_CODED = "source string, row_id long, codes array<long>, rare array<long>"


class _State:
    """Feature masses and chosen sets of one source."""

    def __init__(self, weights: np.ndarray, chosen: list[np.ndarray]) -> None:
        self.weights, self.mass = weights, np.zeros(len(weights))
        self.rare_mass: dict[int, int] = {}
        self.sets = set()
        for codes in chosen:
            self.add(codes)

    def add(self, codes: np.ndarray) -> None:
        self.mass[codes[codes >= 0]] += 1
        for c in codes[codes < 0].tolist():
            self.rare_mass[c] = self.rare_mass.get(c, 0) + 1
        self.sets.add(codes.tobytes())

    def steps(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What one more occurrence of each feature adds; counts: how many rows hold it, read for negative ones."""
        mass, weights = np.empty(len(features)), np.empty(len(features))
        known = features >= 0
        mass[known], weights[known] = self.mass[features[known]], self.weights[features[known]]
        mass[~known], weights[~known] = [self.rare_mass.get(c, 0) for c in features[~known].tolist()], np.log1p(counts[~known].astype(np.float64))
        return weights * (np.sqrt(mass + 1) - np.sqrt(mass))


def greedy(state: _State, ids: np.ndarray, lens: np.ndarray, codes: np.ndarray, counts: np.ndarray, threshold: float, wanted: int) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """Rows (id, codes, counts, gain) added one by one, always the greatest gain, while gains reach the threshold."""
    out: list[tuple[int, np.ndarray, np.ndarray, float]] = []
    features, first, place = np.unique(codes, return_index=True, return_inverse=True)
    counts = counts[first]
    steps = state.steps(features, counts)
    while wanted > len(out) and len(ids):
        starts = np.cumsum(lens) - lens
        gains = np.add.reduceat(steps[place], starts)
        keep = gains >= threshold  # gains only fall, so what is below now stays below
        if not keep.any():
            break
        if not keep.all():
            place = place[np.repeat(keep, lens)]
            ids, lens, gains = ids[keep], lens[keep], gains[keep]
            starts = np.cumsum(lens) - lens
        best = int(np.lexsort((ids, -gains))[0])
        at = place[starts[best] : starts[best] + lens[best]]
        own = features[at]
        if own.tobytes() not in state.sets:
            state.add(own)
            out.append((int(ids[best]), own, counts[at], float(gains[best])))
            steps[at] = state.steps(own, counts[at])
        drop = np.arange(len(ids)) != best
        place = np.delete(place, np.s_[starts[best] : starts[best] + lens[best]])
        ids, lens = ids[drop], lens[drop]
    return out


def _counts_of(codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """For each code how many rows hold it if it is negative, else 0."""
    out = np.zeros(len(codes), np.int64)
    out[codes < 0] = rare
    return out


def _with_rare_counts(encoded: DataFrame, sets: DataFrame) -> DataFrame:
    """encoded with the column rare; only rows with words beyond the frequent ones are moved."""
    keyed = cut(encoded.withColumn("at", F.monotonically_increasing_id()), "variety-encoded")
    sign = F.lit(-(2**63))  # as Coder writes these words
    counts = word_counts(sets).where("word is not null").select(F.col("word").bitwiseOR(sign).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    some = keyed.where("codes[0] < 0")
    held = some.select("at", F.explode(F.filter("codes", lambda c: c < 0)).alias("word")).join(counts, "word")
    held = held.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held"))
    plain = keyed.where("codes[0] >= 0").withColumn("rare", F.expr("cast(array() as array<long>)"))
    columns = ("source", "row_id", "codes", "rare")
    return plain.select(*columns).unionByName(some.join(held, "at").withColumn("rare", F.col("held.n")).select(*columns))


def varied_subset(rows: DataFrame, targets: DataFrame, row_id: str, text: str, source: str, target_source: str, wanted: str, fall: float = 0.85) -> DataFrame:
    """(source, place, row_id, gain): the chosen rows of each source in the order chosen."""
    spark = rows.sparkSession
    names = targets.select(name_key(target_source).alias("source_key"), F.col(target_source).alias("source"), F.col(wanted).cast("int").alias("wanted"))
    need = {r["source"]: r["wanted"] for r in names.collect()}  # the targets: one row a source
    of_target = lookup_join(rows.where(F.col(source).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"), name_key(source).alias("source_key")), names.select("source_key", "source"), ["source_key"])
    sets = cut(word_sets(of_target, "row_id", "text", min_words=1, keep="source"), "variety-words")
    hashes, counts, _ = frequent_words(sets, TOP_WORDS)
    coder = Coder(hashes, counts, 1)
    weights = np.log1p(coder.counts.astype(np.float64))
    shared = spark.sparkContext.broadcast((hashes, counts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(*shared.value, 1)
        for batch in batches:
            lists = batch.column(2)
            lens = np.diff(lists.offsets.to_numpy())
            flat = own.encode(lists.flatten().to_numpy())
            row = np.repeat(np.arange(len(lens)), lens)
            order = np.lexsort((flat, row))
            offsets = np.concatenate([[0], np.cumsum(lens)])
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], names=["source", "row_id", "codes"])

    encoded = sets.mapInArrow(encode, "source string, row_id long, codes array<long>")
    if len(hashes) < TOP_WORDS:
        coded = cut(encoded.withColumn("rare", F.expr("cast(array() as array<long>)")), "variety-codes")
    else:
        coded = cut(_with_rare_counts(encoded, sets), "variety-codes")
    shared_weights = spark.sparkContext.broadcast(weights)
    chosen: dict[str, list[tuple[int, np.ndarray, np.ndarray, float]]] = {s: [] for s in need}

    def round_of(state: dict[str, tuple[float, int, list[np.ndarray]]]):
        """A task: greedy per source over all its rows, a block at a time."""
        sent = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared_weights.value
            states = {s: _State(w, sets) for s, (_, _, sets) in sent.value.items()}
            known = np.arange(len(w))
            steps = {s: st.steps(known, known) for s, st in states.items()}
            held: dict[str, list[tuple]] = {s: [] for s in states}
            size = 0
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                ids = batch.column(1).to_numpy()
                lists = batch.column(2)
                lens = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                flat = lists.flatten().to_numpy()
                counts = _counts_of(flat, batch.column(3).flatten().to_numpy())
                owner = np.repeat(np.arange(len(ids)), lens)
                for s, (threshold, _, _) in sent.value.items():
                    own = names == s
                    if not own.any():
                        continue
                    o, c, m = ids[own], flat[own[owner]], counts[own[owner]]
                    n = lens[own]
                    gain = np.empty(len(c))
                    gain[c >= 0], gain[c < 0] = steps[s][c[c >= 0]], states[s].steps(c[c < 0], m[c < 0])
                    gains = np.add.reduceat(gain, np.cumsum(n) - n)
                    near = gains >= threshold
                    if near.any():
                        held[s].append((o[near], n[near], c[np.repeat(near, n)], m[np.repeat(near, n)]))
                        size += int(near.sum())
                if size > 100_000:  # what is held is thinned to what would be added
                    held, size = thin(states, held), 0
            out = thin(states, held)
            rows = [(s, int(i), c, r) for s, parts in out.items() for part in parts for i, c, r in _split(*part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (2, 3))],
                names=["source", "row_id", "codes", "rare"],
            )

        def thin(states: dict, held: dict) -> dict:
            out: dict[str, list[tuple]] = {s: [] for s in held}
            for s, parts in held.items():
                if not parts:
                    continue
                threshold, left, sets = sent.value[s]
                ids, lens, codes, counts = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(ids, kind="stable")
                starts = np.cumsum(lens) - lens
                codes, counts = (np.concatenate([x[starts[k] : starts[k] + lens[k]] for k in order]) if len(order) else x for x in (codes, counts))
                got = greedy(_State(shared_weights.value, sets), ids[order], lens[order], codes, counts, threshold, left)
                if got:
                    out[s].append((np.array([g[0] for g in got]), np.array([len(g[1]) for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])))
            return out

        return run

    def _split(ids, lens, codes, counts):
        at = 0
        for i, n in zip(ids, lens):
            c = codes[at : at + n]
            yield i, c.tolist(), counts[at : at + n][c < 0].tolist()
            at += n

    top = coded.select("source", F.aggregate("codes", F.lit(0.0), lambda a, c: a + 1.0).alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    thresholds = {r["source"]: r["n"] * float(weights.max() if len(weights) else 0.0) / 2 for r in top}
    seen = set(thresholds)
    left = {s: need[s] for s in need if s in seen and need[s] > 0}
    while left:  # thresholds fall to zero in the end, and a round at zero ends a source
        state = {s: (thresholds[s], left[s], [c for _, c, _, _ in chosen[s]]) for s in left}
        run = round_of(state)
        added = coded.mapInArrow(run, _CODED)
        for parts in (MERGE_WAYS, 1):
            added = added.repartition(parts).mapInArrow(run, _CODED)
        got: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for r in added.collect():  # at most what is still wanted of each source
            codes = np.array(r["codes"], np.int64)
            got.setdefault(r["source"], []).append((r["row_id"], codes, _counts_of(codes, np.array(r["rare"], np.int64))))
        for s, found in got.items():
            ids = np.array([i for i, _, _ in found])
            order = np.argsort(ids)
            codes, counts = (np.concatenate([found[k][c] for k in order]) for c in (1, 2))
            picked = greedy(_State(weights, state[s][2]), ids[order], np.array([len(found[k][1]) for k in order]), codes, counts, state[s][0], left[s])
            chosen[s].extend(picked)
        for s in list(left):
            left[s] = need[s] - len(chosen[s])
            if left[s] <= 0 or state[s][0] == 0.0:
                del left[s]
            else:
                thresholds[s] = 0.0 if thresholds[s] < 1e-3 else thresholds[s] * fall
    flat = [(s, k, i, g) for s, picked in chosen.items() for k, (i, _, _, g) in enumerate(picked, 1)]
    return spark.createDataFrame(flat, "source string, place int, row_id long, gain double")
