import random

import numpy as np
from pyspark.sql import functions as F

from opinark.llm import setjoin, spectral
from opinark.llm.text import words


def brute(rows, least=5):
    sets = {i: set(words(t)) for i, t in rows if t is not None and len(words(t)) >= least}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 17 * len(sets[a] & sets[b]) >= 7 * (len(sets[a]) + len(sets[b])):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {(top(i), i) for i in ids if top(i) != i}


def run(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, sentence_text string").selectExpr("*", "1 AS words", "2 AS root").repartition(3)
    sets = setjoin.word_sets(df, "row_id", "sentence_text").persist()
    links, copied = setjoin.likeness_links(sets)
    members = spectral.with_copies(spectral.spectral_clusters(links), copied)
    return {(r.root, r.row_id) for r in members.where("row_id <> root").collect()}, sets, members


def variants(rng, n_bases, n):
    vocab = [f"w{i}" for i in range(300)]
    common = "the a my and for it was when in".split()
    bases = [rng.sample(vocab, rng.randrange(4, 16)) + rng.sample(common, 6) for _ in range(n_bases)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(ws))
            if rng.random() < 0.5:
                ws[k] = rng.choice(vocab)
            else:
                del ws[k]
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = variants(rng, 60, 700) + [(9000, None), (9001, ""), (9002, "too short"), (9003, "x y z u v"), (9004, "V u z y X!")]
    got, _, _ = run(spark, rows)
    assert got == brute(rows)


def test_large_dense_group_and_copies(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(20)]
    rows = [(i, " ".join(base[:18] + [f"n{rng.randrange(500)}"])) for i in range(1500)] + [(5000 + i, "same five words stand here") for i in range(500)]
    got, _, _ = run(spark, rows)
    assert got == {(0, i) for i in range(1, 1500)} | {(5000, 5000 + i) for i in range(1, 500)}


def test_family_too_large_for_a_task_meets_in_blocks(spark, monkeypatch):
    """A third of all rows are near-copies; the partitions they come to are cut into blocks that meet two by two."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(12)]
    rows = [(i, " ".join(base[:10] + [f"n{rng.randrange(900)}"] + ([f"m{rng.randrange(9)}"] if i % 3 else []))) for i in range(240)] + variants(rng, 40, 400)[240:]
    want = brute(rows)
    monkeypatch.setattr(setjoin, "MAX_TASK_ROWS", 30)
    df = spark.createDataFrame(rows, "row_id long, sentence_text string").repartition(12)
    met = []
    plain = setjoin._met
    monkeypatch.setattr(setjoin, "_met", lambda sent: met.append(plain(sent).persist()) or met[-1])
    sets = setjoin.word_sets(df, "row_id", "sentence_text").persist()
    links, copied = setjoin.likeness_links(sets)
    members = spectral.with_copies(spectral.spectral_clusters(links), copied)
    assert {(r.root, r.row_id) for r in members.where("row_id <> root").collect()} == want
    assert met[0].where("j > 0").count()


def test_chain_of_neighbours(spark):
    tokens = [f"t{i:03}" for i in range(120)]
    rows = [(i, " ".join(tokens[i : i + 20])) for i in range(0, 100, 3)]
    got, _, _ = run(spark, rows)
    assert got == brute(rows) and len(got) == len(rows) - 1


def link_rows(spark, pairs):
    return spark.createDataFrame([(a, b, 0.8) for a, b in pairs], "a long, b long, likeness double")


def clusters(spark, pairs):
    return {(r.node, r.root) for r in spectral.spectral_clusters(link_rows(spark, pairs)).collect()}


def test_long_chain_hub_and_cliques_joined_by_one_link(spark, monkeypatch):
    """Groups that the first level can't finish, and a row whose affinities go to several tasks."""
    monkeypatch.setattr(spectral, "HOT_EDGES", 20)
    monkeypatch.setattr(spectral, "PART_EDGES", 30)
    clique = lambda lo, hi: [(a, b) for a in range(lo, hi) for b in range(a + 1, hi)]
    pairs = [(i, i + 1) for i in range(1, 150)] + [(1000, 1000 + k) for k in range(1, 90)] + clique(2000, 2025) + clique(2025, 2050) + [(2024, 2025)]
    want = {(i, 1) for i in range(1, 151)} | {(1000 + k, 1000) for k in range(90)} | {(i, 2000) for i in range(2000, 2050)}
    assert clusters(spark, pairs + pairs[:3] + [(5, 5)]) == want


def test_groups_come_out_of_the_vectors(spark):
    """The same affinities with constant vectors give another result: nothing but the embedding tells groups apart."""
    pairs = [(1, 2), (2, 3), (10, 11), (20, 21), (21, 22)]
    assert clusters(spark, pairs) == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (20, 20), (21, 20), (22, 20)}
    for part_edges in (spectral.PART_EDGES, 2):  # iterated in one task, and across tasks
        spectral.PART_EDGES, kept = part_edges, spectral.PART_EDGES
        try:
            assert {r.root for r in spectral.spectral_clusters(link_rows(spark, pairs), spread=0.0).collect()} == {1}
        finally:
            spectral.PART_EDGES = kept


def test_few_steps_leave_work_to_further_levels(spark, monkeypatch):
    monkeypatch.setattr(spectral, "PART_EDGES", 4)
    pairs = [(i, i + 1) for i in range(1, 12)] + [(50, 51)]
    got = spectral.spectral_clusters(link_rows(spark, pairs), steps=3)
    assert {(r.node, r.root) for r in got.collect()} == {(i, 1) for i in range(1, 13)} | {(50, 50), (51, 50)}


def test_rows_joined_to_rows_of_other_tasks_are_left_to_the_joins():
    src, dst = np.array([2, 1, 3, 2, 9, 5, 6]), np.array([1, 2, 2, 3, 3, 6, 5])  # 9 is held elsewhere
    nodes, found, leaves, leads = spectral.iterate_here(src, dst, np.ones(7), 3, 1.0)
    assert nodes.tolist() == [1, 2, 3, 5, 6] and leaves.tolist() == [True] * 3 + [False] * 2 and leads[:3].tolist() == [1] * 3
    assert np.abs(found[:, 3] - found[:, 4]).max() < spectral.CELL / 100


def test_vectors_are_enough_to_keep_groups_apart():
    assert spectral.vectors_for(1) == 3 and spectral.vectors_for(10**6) == 3 and spectral.vectors_for(10**10) == 4
    for n in (10, 10**6, 10**9, 10**12):
        assert (2 * spectral.CELL) ** spectral.vectors_for(n) * n * n / 2 < 1e-3


def test_empty(spark):
    assert run(spark, [])[0] == set()
    assert run(spark, [(1, None)])[0] == set()


def test_hot_words_are_split_by_more_words(monkeypatch):
    """Groups beyond the task bound meet by pairs and triples of words, without loss."""
    rng = random.Random(7)
    rows = variants(rng, 40, 400)
    sets = [sorted({setjoin._WordHashes()[w] for w in words(t)}) for _, t in rows]
    keep = [k for k, s in enumerate(sets) if len(words(rows[k][1])) >= 5]
    lens = np.array([len(sets[k]) for k in keep])
    flat = np.array([h for k in keep for h in sets[k]], np.int64)
    hashes, counts = np.unique(flat, return_counts=True)
    coder = setjoin.Coder(hashes, counts, len(keep))
    codes = coder.encode(flat)
    codes = codes[setjoin._row_order(codes, lens)]
    ids = np.array([rows[k][0] for k in keep])
    want = brute(rows)
    for bound in (1_000_000, 40, 5):
        monkeypatch.setattr(setjoin, "MAX_TASK_ROWS", bound)
        up = {i: i for i in ids.tolist()}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for part in range(3):
            a, b, _, _ = setjoin.local_links(ids, lens, codes, coder, setjoin.Likeness(), part, 3)
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = top(x), top(y)
                up[max(p, q)] = min(p, q)
        assert {(top(i), i) for i in up if top(i) != i} == want


def test_short_sets_without_a_further_word_meet_in_the_group_they_are_in(monkeypatch):
    """Sets whose words are used up before the group is small enough, and pairs that share no word beyond the group's."""
    rng = random.Random(9)
    hot = "good very nice works well really".split()
    texts = [" ".join(hot[:n] + hot[:1] * (5 - n)) for n in range(1, 7) for _ in range(4)]
    texts += [" ".join([*rng.sample(hot, n), *(f"x{rng.randrange(40)}" for _ in range(k)), *["good"] * 3]) for n in (2, 3, 4, 5, 6) for k in (0, 1, 2) for _ in range(12)]
    rows = list(enumerate(texts))
    sets = [sorted({setjoin._WordHashes()[w] for w in words(t)}) for _, t in rows]
    lens, flat = np.array([len(s) for s in sets]), np.array([h for s in sets for h in s], np.int64)
    hashes, counts = np.unique(flat, return_counts=True)
    coder = setjoin.Coder(hashes, counts, len(rows))
    codes = coder.encode(flat)
    codes = codes[setjoin._row_order(codes, lens)]
    ids, want = np.arange(len(rows)), brute(rows)
    for bound, small in ((3, 2), (1, 1), (1_000_000, 1), (3, 40)):
        monkeypatch.setattr(setjoin, "MAX_TASK_ROWS", bound)
        monkeypatch.setattr(setjoin, "SMALL_GROUP", small)
        up = list(range(len(rows)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for part in range(3):
            a, b, _, _ = setjoin.local_links(ids, lens, codes, coder, setjoin.Likeness(), part, 3)
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = top(x), top(y)
                up[max(p, q)] = min(p, q)
        assert {(top(i), i) for i in range(len(up)) if top(i) != i} == want


def test_typical_members_stand_in_the_middle(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g i"), (3, "a b c d e f g h j"), (4, "q r s t u")]
    _, sets, members = run(spark, rows)
    best = spectral.typical_members(members, sets, top=2).orderBy("rank").collect()
    assert [r.row_id for r in best] == [1, 2] and best[0].cluster_size == 3
    assert members.where(F.col("row_id") == 4).count() == 0


def joined(ids, lens, codes, coder, parts, **how):
    """The groups, as brute() gives them, that the links of all partitions make; rows come only to partitions they are sent to."""
    up = {i: i for i in ids.tolist()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    part, rec = setjoin._send_to(lens, codes, coder, setjoin.Likeness(), parts, how["most"], how["classes"])
    starts = np.cumsum(lens) - lens
    for p in range(parts):
        own = rec[part == p]
        a, b, _, _ = setjoin.local_links(ids[own], lens[own], codes[setjoin._gather(starts, lens, own)], coder, setjoin.Likeness(), p, parts, **how)
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    return {(top(i), i) for i in up if top(i) != i}


def test_pairs_within_classes_of_words_lose_no_link(monkeypatch):
    """Frequent words are split into pairs of a class: groups as by brute force, at fewer partitions a row."""
    monkeypatch.setattr(setjoin, "GROUPED_ROWS", 100)
    hot = "good very nice works well really".split()
    for seed, small in ((21, 1), (22, 3), (23, 40)):
        rng = random.Random(seed)
        monkeypatch.setattr(setjoin, "SMALL_GROUP", small)
        near = [rng.sample([f"v{i}" for i in range(60)], rng.randrange(3, 32)) for _ in range(60)]
        texts = [t for _, t in variants(rng, 30, 200)]
        for _ in range(240):  # words of all frequencies, some replaced and dropped
            ws = list(rng.choice(near))
            for _ in range(rng.randrange(0, 1 + len(ws) // 4)):
                ws[rng.randrange(len(ws))] = f"v{rng.randrange(60)}"
            texts.append(" ".join(ws))
        texts += [" ".join([*rng.sample(hot, n), *(f"x{rng.randrange(40)}" for _ in range(k)), *["good"] * 3]) for n in (2, 4, 6) for k in (0, 1, 2) for _ in range(8)]
        kept = [(i, t) for i, t in enumerate(texts) if len(words(t)) >= 5]
        sets = [sorted({setjoin._WordHashes()[w] for w in words(t)}) for _, t in kept]
        ids, lens, flat = np.array([i for i, _ in kept]), np.array([len(s) for s in sets]), np.array([h for s in sets for h in s], np.int64)
        hashes, counts = np.unique(flat, return_counts=True)
        coder = setjoin.Coder(hashes, counts, len(kept))
        codes = coder.encode(flat)
        codes = codes[setjoin._row_order(codes, lens)]
        want = brute(kept)
        for most in (1, 5, 40):
            for classes in setjoin.CLASSES:
                assert joined(ids, lens, codes, coder, 7, most=most, classes=classes) == want, (seed, most, classes)


def test_many_partitions_a_row_are_met_in_waves(spark, monkeypatch):
    """All words are frequent: partitions are as many as rows are sent to, and what a wave sends is bounded."""
    rng = random.Random(31)
    bases = [rng.sample([f"v{i}" for i in range(40)], 20) for _ in range(90)]
    rows = [(i, " ".join(["w", *rng.choice(bases)[rng.randrange(3) :], f"v{rng.randrange(40)}"])) for i in range(400)]
    rows += [(1000 + i, rows[7 * i][1]) for i in range(50)]  # copies
    df = spark.createDataFrame(rows, "row_id long, sentence_text string").repartition(3)
    sets = setjoin.word_sets(df, "row_id", "sentence_text").persist()
    monkeypatch.setattr(setjoin, "WAVE_COPIES", 5)
    monkeypatch.setattr(setjoin, "SAMPLE_ROWS", 300)
    waves = []
    plain = setjoin._met
    monkeypatch.setattr(setjoin, "_met", lambda sent: waves.append(sent.agg(F.sum("n"), F.max("part")).first()) or plain(sent))
    links, copied = setjoin.likeness_links(sets, most=40)
    members = spectral.with_copies(spectral.spectral_clusters(links), copied)
    assert {(r.root, r.row_id) for r in members.where("row_id <> root").collect()} == brute(rows)
    sent = sum(n for n, _ in waves)
    assert len(waves) > 1 and all(n < 1.5 * 5 * len(rows) for n, _ in waves)
    assert max(p for _, p in waves) > 0.8 * sent / 40  # as many partitions as rows go to, not as for one group a word
