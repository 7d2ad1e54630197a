import random

import numpy as np
from pyspark.sql import functions as F

from opinark.llm import overlap
from opinark.llm.text import words


def run(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, split string, sentence_text string").selectExpr("*", "1 AS side", "2 AS seq", "3 AS hash")
    side = F.when(F.col("split") == "train", 0).when(F.col("split") == "test", 1)
    seqs, members = overlap.word_sequences(df, "row_id", "sentence_text", side)
    pairs = overlap.overlaps(seqs)
    a = members.where("side = 0").select(F.col("seq_id").alias("a"), F.col("row_id").alias("x"))
    b = members.where("side = 1").select(F.col("seq_id").alias("b"), F.col("row_id").alias("y"))
    return {(r.x, r.y): (r.likeness, r.coverage) for r in pairs.join(a, "a").join(b, "b").collect()}


def brute(rows):
    sets = [(i, s, set(words(t))) for i, s, t in rows if t is not None and len(words(t)) >= 5]
    return {(i, j) for i, s, x in sets if s == "train" for j, r, y in sets if r == "test" and 17 * len(x & y) >= 7 * (len(x) + len(y))}


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = rng.sample(vocab, rng.randrange(20, 34))
        for _ in range(4):
            ws = list(base)
            for _ in range(rng.randrange(0, 4)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rows.append((n, rng.choice(["train", "test", "other", None]), " ".join(ws)))
            n += 1
    rows += [(9001, "train", None), (9002, "test", ""), (9003, "test", "only four words here"), (9004, "train", "one two three four five six"), (9005, "test", "One, two: three four five SIX!"), (9006, "test", "one two three four five six"), (9007, "test", "one two three x four five six")]
    got = run(spark, rows)
    assert set(got) == brute(rows)
    assert got[9004, 9005] == (1.0, 1.0)


def test_empty_sides(spark):
    assert run(spark, [(1, "train", "one two three four five six")]) == {}
    assert run(spark, []) == {}


def test_alignment_counts_words_around_seeds():
    a, b = "a b c d e f g h".split(), "a b X c d e f Y h".split()
    assert overlap.aligned_words(a, b, [(2, 3)], 4) == 7
    assert overlap.chain([(0, 5), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]


def test_winnowing_keeps_a_hash_of_every_window():
    """Several sequences at once, some shorter than a window, with ties: the same places as window by window."""
    rng = random.Random(8)
    runs = np.array([rng.randrange(0, 12) for _ in range(200)])
    owner = np.repeat(np.arange(len(runs)), runs)
    place = np.concatenate([np.arange(n) for n in runs])
    hashes, order = (np.array([rng.randrange(6) for _ in owner], np.int64) for _ in range(2))
    for window in (1, 3, 4):
        want, at = [], 0
        for n in runs.tolist():
            picked = set()
            for start in range(max(1, n - window + 1) if n else 0):
                picked.add(min(range(start, min(start + window, n)), key=lambda i: (order[at + i], hashes[at + i], -i)))
            want.extend(sorted(at + i for i in picked))
            at += n
        assert overlap.winnow(owner, place, runs, hashes, order, window).tolist() == want
    none = np.array([], np.int64)
    assert overlap.winnow(none, none, none, none, none, 3).tolist() == []


def test_evenly_spaced_edits_and_reordered_clauses(spark):
    """Pairs of the likeness that share no run of words that winnowing would have to select."""
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (5, 8, 12, 15, 16, 20, 30, 45, 60):
        for _ in range(6):
            base = rng.sample(vocab, size)
            edited = [f"e{n}x{i}" if i % 6 == 5 else w for i, w in enumerate(base)]
            clauses = [base[i : i + 3] for i in range(0, size, 3)]
            shuffled = [w for c in rng.sample(clauses, len(clauses)) for w in c]
            for split, ws in (("train", base), ("test", edited), ("test", shuffled), ("test", base[::-1]), ("other", base), ("train", base[: size * 3 // 4])):
                rows.append((n, split, " ".join(ws)))
                n += 1
    # the runs the long pairs share are in many other rows, those that differ in one
    rows += [(n + i, split, text) for i, (split, text) in enumerate((s, t) for _, s, t in rows[:120] for s in ("train", "test"))]
    got = run(spark, rows)
    assert set(got) == brute(rows)


def test_words_of_many_rows_lose_no_pair(spark, monkeypatch):
    """Hot words, which bring sequences together by several words only, also where these are all the words there are."""
    monkeypatch.setattr(overlap, "GROUP_ROWS", 3)
    rng = random.Random(11)
    hot = [f"h{i}" for i in range(12)]
    texts = [" ".join(rng.choices(hot[: rng.randrange(1, 13)], k=rng.randrange(5, 16))) for _ in range(300)]
    rows = [(i, rng.choice(["train", "test"]), t) for i, t in enumerate(texts)]
    assert set(run(spark, rows)) == brute(rows)


def test_common_words_against_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert overlap._common(a, b) == row[-1][-1]
    assert overlap._common(["x"] * 20_000, ["x"] * 20_000) == 20_000
