import random

import pytest

from opinark.llm import packing

pt = pytest.importorskip("public_tokenizers")


def run(spark, docs, sizes):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS load", "2 AS members").repartition(3)
    return packing.pack(df, "doc_id", "text", sizes, pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN)


def test_packs_hold_every_token_once_and_cut_only_long_texts(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "long " * 3000), (903, "<|endoftext|> is plain text")]
    encode = packing.tokenizer(open(pt.path("byte_bpe_50k.tiktoken"), "rb").read(), pt.PATTERN).encode_ordinary
    lengths = {d: len(encode(t)) for d, t in docs if t}
    for name, capacity in (("small", 64), ("large", 512)):
        packs = run(spark, docs, [(name, capacity)]).collect()
        seen = {}
        for p in packs:
            assert 0 < p.load <= capacity and p.load == sum(m.token_end - m.token_start for m in p.members)
            for m in p.members:
                seen.setdefault(m.doc_id, []).append((m.token_start, m.token_end))
        assert set(seen) == set(lengths)
        for d, pieces in seen.items():
            pieces.sort()
            assert pieces[0][0] == 0 and pieces[-1][1] == lengths[d] and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert len(pieces) == 1 or lengths[d] > capacity
        assert len(packs) <= -(-sum(lengths.values()) // capacity) * 1.05 + 1


def test_rounds_merge_what_partitions_leave(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 40)
    docs = [(i, "word " * 20) for i in range(400)]
    packs = run(spark, docs, [("p", 100)]).collect()
    assert sum(len(p.members) for p in packs) == 400 and len(packs) <= 110


def test_best_fit():
    bins = packing.best_fit([5, 7, 3, 2, 3], 10)
    assert sorted(sorted(b) for b in bins) == [[0, 3, 4], [1, 2]]
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [[0], [1]]


def test_empty(spark):
    assert run(spark, [], [("p", 10)]).count() == 0


def test_tree_of_many_nodes_loses_nothing(spark, monkeypatch):
    """Three levels; nodes that may hand on two packs each keep the rest as they are."""
    docs = [(i, "word " * (3 + i % 23)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    monkeypatch.setattr(packing, "FAN", 2)
    least = -(-sum(len(t.split()) for _, t in docs) // 100)
    for most in (packing.MERGE_ITEMS, 2):
        monkeypatch.setattr(packing, "MERGE_ITEMS", most)
        packs = packing.pack(df, "doc_id", "text", [("p", 100)], pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN).collect()
        assert sorted(m.doc_id for p in packs for m in p.members) == list(range(600)) and all(p.load <= 100 for p in packs)
    assert len(packs) <= least * 1.2


def test_capacity_must_hold_a_token(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], [("p", 0)])


def test_best_fit_goes_on_in_open_bins():
    assert packing.best_fit([3, 4, 8], 10, [6, 10, 7]) == [[1], [], [0], [2]]
    rng = random.Random(4)
    for _ in range(50):
        loads, sizes = [], []
        for _ in range(4):  # texts in four runs: no two bins fit into one
            sizes = [rng.randrange(1, 60) for _ in range(30)]
            bins = packing.best_fit(sizes, 100, loads)
            assert sorted(i for b in bins for i in b) == list(range(30))
            loads = [load + sum(sizes[i] for i in b) for load, b in zip(loads + [0] * (len(bins) - len(loads)), bins)]
            assert max(loads) <= 100 and sum(sorted(loads)[:2]) > 100


def test_all_underfull_packs_meet_the_further_texts_of_a_partition(spark, monkeypatch):
    """Twice as many packs as a node hands on are open when the texts come that fill them."""
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 10_000)
    n = 2 * packing.MERGE_ITEMS
    docs = spark.range(0, 2 * n, 1, 1).selectExpr("id AS doc_id", f"trim(repeat('word ', if(id < {n}, 60, 40))) AS text")
    packs = packing.pack(docs, "doc_id", "text", [("p", 100)], pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN).collect()
    assert len(packs) == n and {p.load for p in packs} == {100}
    assert sorted(m.doc_id for p in packs for m in p.members) == list(range(2 * n))


def test_no_two_underfull_packs_fit_into_one(spark, monkeypatch):
    """Of partitions with far more packs than are handed on, and a tree of several levels."""
    monkeypatch.setattr(packing, "MERGE_ITEMS", 1)
    monkeypatch.setattr(packing, "FAN", 2)
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 150)
    docs = spark.range(0, 3000, 1, 9).selectExpr("id AS doc_id", "trim(repeat('word ', cast(if(id % 331 = 0, 5 + id % 30, 51 + pmod(hash(id), 45)) AS int))) AS text")
    packs = packing.pack(docs, "doc_id", "text", [("p", 100)], pt.path("byte_bpe_50k.tiktoken"), pt.PATTERN).collect()
    loads = sorted(p.load for p in packs if p.load < 99)
    assert len(loads) > 1000 and loads[0] + loads[1] > 100
    assert sorted(m.doc_id for p in packs for m in p.members) == list(range(3000))
