"""Profiles, samples, metrics, clusters and files."""

import random

import pytest
from pyspark.sql import functions as F

from opinark import schemas
from opinark.operators import cluster, metrics, profile, sample
from opinark.sources import io


def test_histogram_and_buckets(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    got = [(r.bucket, r.low, r.high, r.n) for r in profile.histogram(df, "v", 2).orderBy("bucket").collect()]
    assert got == [(1, 1.0, 2.5, 2), (2, 2.5, 4.0, 2)]
    b = spark.createDataFrame([(v,) for v in (0.0, 4.99, 5.0, 6.0, 7.0)], "v double").select(profile.bucketize("v", range(7)).alias("b"))
    assert [r.b for r in b.collect()] == [0, 4, 5, 5, None]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r.bucket, r.n) for r in profile.histogram(same, "v", 5).collect()] == [(1, 2)]


def test_profiles_of_empty_tables(spark):
    df = spark.createDataFrame([], "a string, b double, c array<string>")
    for f in (profile.null_profile, profile.nan_profile, profile.empty_list_profile):
        assert all(r.total == 0 and r.percent == 0.0 for r in f(df).collect())


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"c":[{"d":1},{"d":2}]}',), (None,), ("bad",)], "j string")
    assert {r.field: r.n for r in profile.json_field_paths(df, "j").collect()} == {"a": 1, "a.b": 1, "c": 1, "c__list_of.d": 2}


def test_join_coverage_counts_keys_once(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    r = profile.join_coverage(left, right, "k").first()
    assert (r.matched, r.unmatched) == (2, 2)


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([(i, i % 3 == 0 or None) for i in range(1000)], "id long, s boolean")
    cut = lambda d: {r.id: r.split for r in sample.stratified_split(d, ["s"], "id", [("train", 0.8), ("test", 0.2)]).collect()}
    a = cut(df)
    assert a == cut(df.repartition(7)) and len(a) == 1000
    for stratum in ([i for i in range(1000) if i % 3 == 0], [i for i in range(1000) if i % 3]):
        assert sum(a[i] == "train" for i in stratum) == round(len(stratum) * 0.8)


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 4)
    assert sample.exact(df, "id", 17).count() == 17 and sample.exact(df, "id", 5000).count() == 1000
    assert {r["count"] for r in sample.per_group(df, "g", "id", 8).groupBy("g").count().collect()} == {8}
    assert 60 < sample.bernoulli(df, "id", 0.1).count() < 140
    up = sample.upsample(df, F.col("g") == 1, 3)
    assert up.count() == 1500


def test_leak_free(spark):
    train = spark.createDataFrame([(1, "A b"), (2, "a b "), (3, None), (4, "c")], "id long, t string")
    test = spark.createDataFrame([("a b",), (None,)], "t string")
    assert {r.id for r in sample.leak_free(train, test, "t").collect()} == {3, 4}
    assert {r.id for r in sample.leak_free(train, test, "t", normalize=False).collect()} == {1, 2, 3, 4}


def test_metrics_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(auc, abs=1e-6)
    for r in metrics.threshold_sweep(df, "y", "s", [0.0, 0.5, 2.0]).collect():
        assert r.tp == sum(s >= r.threshold for s in pos) and r.fp == sum(s >= r.threshold for s in neg)
        assert 0 <= r.f1 <= 1


def test_set_scores(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "g array<string>, p array<string>")
    r = metrics.set_scores(df, "g", "p").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    empty = spark.createDataFrame([([], []), (None, None)], "g array<string>, p array<string>")
    assert metrics.set_scores(empty, "g", "p").first().f1 == 0.0


def test_class_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    rep = {r.label: (r.tp, r.n_true, r.n_predicted, r.f1) for r in metrics.class_report(df, "y", "p").collect()}
    assert rep["a"] == (1, 2, 1, 0.666667) and rep["b"] == (1, 1, 3, 0.5) and rep["c"] == (0, 1, 0, 0.0)


def test_nearest_centroid_and_kmeans(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    cs = spark.createDataFrame([(0, [5.0, 0.0]), (1, [0.0, 1.0])], "c int, m array<double>")
    assert {r.id: r.nearest for r in cluster.nearest_centroid(df, "v", cs, "c", "m").collect()} == {1: 0, 2: 1, 3: 0}
    assert cluster.kmeans(df, "v", 2).count() == 3


def test_conform_and_validate(spark):
    df = spark.createDataFrame([("x", "3", "z")], "parent_asin string, rating string, extra string")
    out = schemas.conform(df, schemas.SENTENCES)
    assert out.schema.simpleString() == schemas.SENTENCES.simpleString() and out.first().rating == 3.0
    with pytest.raises(ValueError, match="sentence_text"):
        schemas.validate(df, ["parent_asin", "sentence_text"])


def test_files(spark, tmp_path):
    df = spark.range(250).withColumn("t", F.concat(F.lit('a "q"\nb, '), F.col("id")))
    io.write_csv(df, str(tmp_path / "csv"))
    assert io.read_labels_csv(spark, str(tmp_path / "csv")).where("t = 'a \"q\"\nb, 7'").count() == 1
    io.write_parquet(df.withColumn("p", F.col("id") % 2), str(tmp_path / "pq"), by=["p"], compression="gzip")
    io.write_missing(spark.createDataFrame([(999, "n", 1)], "id long, t string, p long"), str(tmp_path / "pq"), "p")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 126
    numbered = io.slices(df, ["id"], 100)
    assert {(r.slice_no, r["count"]) for r in numbered.groupBy("slice_no").count().collect()} == {(0, 100), (1, 100), (2, 50)}
    (tmp_path / "r.jsonl").write_text('{"rating":5.0,"title":"t","timestamp":1,"images":[]}\n{bad\n')
    assert io.read_reviews(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "m.jsonl").write_text('{"parent_asin":"A","features":["x"],"details":"{}"}\n')
    assert io.read_meta(spark, str(tmp_path / "m.jsonl")).first().features == ["x"]
    (tmp_path / "man.json").write_text('{"train":{"books":["a","b"]}}')
    assert io.read_manifest(spark, str(tmp_path / "man.json"), "train").count() == 2
    for n in (10, 9, 1):
        (tmp_path / f"chunk_{n}.parquet").write_text("")
    names = [n.rsplit("_", 1)[-1] for n in io.list_chunks(spark, str(tmp_path), r"chunk_")]
    assert names == ["1.parquet", "9.parquet", "10.parquet"]
    assert io.select_chunks(["c_1", "c_9", "c_10"], first=2, most=1) == ["c_9"]
    assert io.pending(df, df.where("id < 200"), ["id"]).count() == 50


def test_stream(spark, tmp_path):
    from opinark.streaming import stage1

    rows = [(1, "T", "Good. Bad!", 10), (1, "T", "Good. Bad!", 10), (2, None, "Fine?", 20), (3, None, None, 30)]
    df = spark.createDataFrame(rows, "review_id long, title string, text string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    sentences = stage1.sentence_stream(stage1.read_stream(spark, str(tmp_path / "in"), df.schema), "ts", ["review_id"])
    stage1.write_stream(sentences, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.review_id, r.sentence_id, r.sentence_text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1, "t"), (1, 2, "good"), (1, 3, "bad"), (2, 1, "fine")}


def test_hot_join_gives_the_rows_of_a_plain_join(spark, monkeypatch):
    from opinark import runtime

    big = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 30 + ["b"] * 3 + ["c"] + ["z"] * 40 + [None] * 20)], "id long, k string")
    small = spark.createDataFrame([("a", 30, 1.5), ("b", 3, None), ("c", 1, 2.5)], "k string, n long, v double")
    want = {(i, "a", 1.5) for i in range(30)} | {(i, "b", None) for i in (30, 31, 32)} | {(33, "c", 2.5)}
    for bound in (2, 10, 100):
        monkeypatch.setattr(runtime, "HOT_ROWS", bound)
        got = runtime.hot_join(big, small, "k", "n")
        assert {(r.id, r.k, r.v) for r in got.collect()} == want and got.count() == len(want)
