import random

from opinark import runtime
from opinark.llm import components


def brute(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for node, through in pairs:
        if node is not None and through is not None:
            a, b = top(("n", node)), top(("t", through))
            up[max(a, b)] = min(a, b)
    low = {}
    for k in list(up):
        if k[0] == "n":
            low[top(k)] = min(low.get(top(k), k[1]), k[1])
    return {k[1]: low[top(k)] for k in up if k[0] == "n"}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "item string, review string").selectExpr("*", "1 AS node", "2 AS a", "3 AS root")
    return {r.node: r.root for r in components.hash_to_min(components.star_edges(df, "item", "review")).collect()}


def check(spark, pairs):
    got, want = run(spark, pairs), brute(pairs)
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_random_graph_and_nulls(spark):
    random.seed(3)
    pairs = [(f"i{random.randrange(200):03}", f"r{random.randrange(260)}") for _ in range(420)] + [(None, "r1"), ("i001", None), ("i001", "r1"), ("i001", "r1")]
    check(spark, pairs)


def test_hot_reviews_and_roots_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    random.seed(4)
    hub = [(f"h{i:03}", "hub") for i in range(120)] + [(f"h{i:03}", f"r{i}") for i in range(0, 120, 7)]
    check(spark, hub + [(f"i{random.randrange(90):02}", f"q{random.randrange(120)}") for _ in range(150)])


def test_long_path_hub_and_empty(spark):
    path = [(f"p{i:03}", f"e{j}") for i in range(60) for j in (i, i + 1)]
    hub = [(f"h{i:03}", "hub") for i in range(300)]
    check(spark, path + hub)
    assert run(spark, []) == {}


def test_splits_keep_groups_and_proportions(spark):
    random.seed(4)
    sizes = [("big", 100_000)] + [(f"c{i}", random.randrange(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(sizes, "root string, n long")
    got = components.assign_splits(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    assert len(got) == len(sizes)
    total = sum(n for _, n in sizes)
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.n for r in got if r.split == name) / total - share) < 0.002
    assert components.assign_splits(df.limit(0), [("train", 1.0)]).count() == 0
