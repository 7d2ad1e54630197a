import numpy as np

from opinark.llm import variety


def run(spark, rows, targets):
    df = spark.createDataFrame(rows, "row_id long, category_name string, sentence_text string").selectExpr("*", "'x' AS source", "1 AS gain", "2 AS codes")
    t = spark.createDataFrame(targets, "category_name string, n_wanted int")
    out = variety.varied_subset(df, t, "row_id", "sentence_text", "category_name", "category_name", "n_wanted").collect()
    got = {}
    for r in sorted(out, key=lambda r: r.place):
        got.setdefault(r.source, []).append(r.row_id)
    return got


def test_look_alikes_do_not_fill_the_subset(spark):
    alike = [(i, "Books", "love it so much") for i in range(200)]
    topics = [(1000 + i, "books", f"topic{i} word{i} more{i} text{i}") for i in range(6)] + [(2000 + i, "BOOKS", f"topic{i} word{i} more{i} other{i}") for i in range(6)]
    got = run(spark, alike + topics + [(3000, None, "a b c"), (3001, "Other", "a b c"), (3002, "Books", None), (3003, "Books", " ")], [("Books", 7)])["Books"]
    assert len(got) == 7 and sum(i < 200 for i in got) == 1
    assert len({i % 1000 for i in got if i >= 1000}) == 6


def test_fewer_rows_than_wanted_and_none(spark):
    rows = [(1, "A", "x y z"), (2, "A", "x y z"), (3, "A", "p q r"), (4, "B", "one two")]
    got = run(spark, rows, [("A", 10), ("B", 0), ("C", 3)])
    assert sorted(got["A"]) == [1, 3] and "B" not in got and "C" not in got
    assert run(spark, [], [("A", 2)]) == {}


def test_words_beyond_the_frequent_ones_are_features_too(spark, monkeypatch):
    monkeypatch.setattr(variety, "TOP_WORDS", 3)
    rows = [(i, "A", "so very good") for i in range(50)] + [(100 + i, "A", f"so very good rare{i} odd{i}") for i in range(4)] + [(200 + i, "A", f"lone{i}") for i in range(3)]
    got = run(spark, rows, [("A", 20)])["A"]
    assert sorted(got) == [0, *range(100, 104), *range(200, 203)]
    assert run(spark, rows, [("A", 4)])["A"][0] >= 100


def test_the_size_of_the_frequent_table_does_not_change_the_choice():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(np.arange(rng.integers(20, 201)), rng.integers(3, 12), replace=False)) for _ in range(400)]
    flat, lens, ids = np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(400)
    n = np.bincount(flat, minlength=200)

    def choose(known):
        """The first words have weights by place, the others carry their counts."""
        codes = np.where(flat < known, flat, flat - 1_000_000)
        order = np.lexsort((codes, np.repeat(ids, lens)))
        state = variety._State(np.log1p(n[:known].astype(float)), [])
        got = variety.greedy(state, ids, lens, codes[order], np.where(codes < 0, n[flat], 0)[order], 0.5, 25)
        return [g[0] for g in got], [g[3] for g in got]

    whole, gains = choose(200)
    for known in (150, 20):
        got, own = choose(known)
        assert got == whole and np.allclose(own, gains)
