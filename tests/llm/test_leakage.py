import random

from opinark.llm import leakage
from opinark.llm.text import TAG, words


def brute(docs, items, k):
    out = set()
    for i, t in items:
        w = words(t or "")
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, x in docs:
            v = words(TAG.sub(" ", x or ""))
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n_words")
    i = spark.createDataFrame(items, "item_id long, text string")
    return leakage.leaked_spans(d.drop("item_id"), "doc_id", "text", i, "item_id", "text", k)


def test_against_brute_force(spark):
    rng = random.Random(10)
    vocab = list("abcdef")
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 25)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c")]
    docs = [(d, " ".join(rng.choice(vocab) for _ in range(60))) for d in range(60)] + [(900, None), (901, " ")]
    docs += [(902, "x " + items[3][1].replace(" ", "<br/>") + " y"), (902, "again " + (items[5][1] or ""))]
    for k in (5, 7):
        got = {(r.doc_id, r.item_id) for r in run(spark, docs, items, k).collect()}
        assert got == brute(docs, items, k)


def test_blocks_of_items_lose_nothing(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, " ".join(str(rng.randrange(9)) for _ in range(15))) for i in range(20)]
    docs = [(d, " ".join(str(rng.randrange(9)) for _ in range(10)) + " " + items[d % 20][1]) for d in range(30)]
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 40)
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, 12).collect()} == brute(docs, items, 12)


def test_hot_item_long_item_and_full_filter_lose_nothing(spark, monkeypatch):
    """An item that stands in every text, an item taken in pieces, several tasks an automaton, and a filter that holds nothing back."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(300))
    items = [(i, " ".join(str(rng.randrange(9)) for _ in range(15))) for i in range(12)] + [(50, long), (51, "a stock phrase of quite a few words that all texts hold twice")]
    docs = [(d, f"{d} {items[-1][1]} {items[d % 12][1]} " + " ".join(long.split()[d * 9 : d * 9 + 30])) for d in range(30)]
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    monkeypatch.setattr(leakage, "TASK_WORDS", 100)
    want = brute(docs, items, 12)
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, 12).collect()} == want
    monkeypatch.setattr(leakage, "FILTER_BITS", 1 << 10)
    assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, 12).collect()} == want


def test_cleaned_text_has_no_leak_left(spark):
    items = [(1, "one two three four five six")]
    docs = [(1, "Before it. One two, three <b>four</b> five six! After that more words stand here."), (2, "one two three four five six"), (3, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in leakage.cleaned(df, "doc_id", "text", run(spark, docs, items, 5)).collect()}
    assert set(got) == {1, 3} and got[3] == "nothing" and "Before it." in got[1] and "three" not in got[1] and "After that" in got[1]


def test_no_items(spark):
    assert run(spark, [(1, "a b")], [], 3).count() == 0
