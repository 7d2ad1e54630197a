import pytest

from opinark.operators import triplets


def parse(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(triplets.parse("t").alias("p")).first()
    return [tuple(t) for t in row.p]


@pytest.mark.parametrize(
    "text, want",
    [
        ('[["yarn","good",2],["yarn","really special",2]]', [("yarn", "good", 2), ("yarn", "really special", 2)]),
        ("[['a', 'b', '2']]", [("a", "b", 2)]),
        ('[["a","b",3],["a","b"],["a","b","x"],[" ","b",1]]', []),
        ('[{"aspect":"a","opinion":"b","sentiment":2}]', [("a", "b", 2)]),
        ('[{"aspect":"a","opinion":"b","sentiment":0}]', [("a", "b", 0)]),
        ('[{"aspect_phrase":"a","opinion_phrase":"b","sentiment_int":1}]', [("a", "b", 1)]),
        ("[]", []),
        ("nan", []),
        (None, []),
        ("no list", []),
    ],
)
def test_parse(spark, text, want):
    assert parse(spark, text) == want


@pytest.mark.parametrize("text, want", [("battery life|great|2", ("battery life", "great", 2)), ("screen| poor |NEG", ("screen", "poor", 0)), ("a|b", None), ("a|b|maybe", None), (" |b|1", None), (None, None)])
def test_pipes(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(triplets.parse_pipes("t").alias("p")).first()
    assert (row.p and tuple(row.p)) == want


def test_serial_round_trip(spark):
    df = spark.createDataFrame([(1, [("screen", "bad", 0), ("battery", "great", 2)]), (2, [])], f"id long, t {triplets.TRIPLETS}")
    rows = df.withColumn("s", triplets.serialize("t")).withColumn("b", triplets.deserialize("s")).orderBy("id").collect()
    assert rows[0].s == "(screen, bad, negative) ; (battery, great, positive)" and rows[1].s == "none"
    assert [r.b for r in rows] == [r.t for r in rows]


def test_majority_matrix_and_stats(spark):
    df = spark.createDataFrame([(1, [("Pen", "x", 0), ("pen ", "y", 0), ("ink", "z", 2)]), (2, [("ink", "x", 1), ("ink", "x", 2)]), (3, [])], f"id long, t {triplets.TRIPLETS}")
    from pyspark.sql import functions as F

    got = {r.id: r.m for r in df.select("id", triplets.majority(F.transform("t", lambda x: x["sentiment"])).alias("m")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    m = {r.aspect: (r.negative, r.neutral, r.positive, r.dominant) for r in triplets.aspect_matrix(triplets.flatten(df, "t")).collect()}
    assert m == {"pen": (2, 0, 0, "negative"), "ink": (0, 1, 2, "positive")}
    s = triplets.stats(df, "t").first()
    assert (s.n_rows, s.n_with, s.n_without, s.n_multi, s.n_triplets, s.most_triplets) == (3, 2, 1, 2, 5, 3)
