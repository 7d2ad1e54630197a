import math
import random

from opinark.llm import cutoffs


def brute(rows, targets):
    out = {}
    for name, fraction in targets:
        key = name.lower().replace("-", "_").replace(" ", "_")
        s = sorted((v for c, v in rows if c is not None and v is not None and not math.isnan(v) and 0 <= v <= 1 and c.strip().lower().replace("-", "_").replace(" ", "_") == key), reverse=True)
        need = -(-len(s) * round(fraction * 100) // 100)
        if need:
            out[name] = (s[need - 1], sum(v >= s[need - 1] for v in s))
    return out


def run(spark, rows, targets):
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(rows)], "row_id long, category_name string, score double")
    df = df.selectExpr("*", "1 AS fraction", "2 AS cutoff", "3 AS source_name")
    t = spark.createDataFrame(targets, "category_name string, keep_fraction double")
    scored = cutoffs.scored_rows(df, t, "category_name", "score", "category_name", "keep_fraction")
    found = cutoffs.cutoffs(scored, bins=8)
    kept = {r.source_name: r.n for r in cutoffs.kept_rows(scored, found).groupBy("source_name").count().withColumnRenamed("count", "n").collect()}
    got = {r.source_name: (r.cutoff, r.n_kept) for r in found.collect()}
    assert kept == {k: n for k, (_, n) in got.items()}
    return got


def test_against_brute_force(spark):
    random.seed(1)
    names = ["Kindle_Store", " kindle store", "KINDLE-STORE", "Software", None, "Other"]
    rows = [(random.choice(names), random.choice([None, float("nan"), -1.0, 1.5, 0.5, random.random(), round(random.random(), 2)])) for _ in range(3000)]
    targets = [("Kindle_Store", 0.35), ("Software", 0.8), ("Absent", 0.5)]
    assert run(spark, rows, targets) == brute(rows, targets)


def test_ties_extremes_and_nothing(spark):
    rows = [("A", 0.5)] * 10 + [("B", 1e-300), ("B", 2e-300), ("B", 1.0), ("C", 0.0)]
    targets = [("A", 0.01), ("B", 0.5), ("C", 1.0)]
    assert run(spark, rows, targets) == brute(rows, targets)
    assert run(spark, rows, [("A", 0.0)]) == {}
    assert run(spark, [], [("A", 0.5)]) == {}
