import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark.functions import text as X
from opinark.operators import metrics, sample, scoring, spans
from opinark.sources import io

GATE = T.StructType([T.StructField("gate", T.DoubleType())])


def gate(batch_rows=256):
    def load():
        return lambda pdf: pd.DataFrame({"gate": [float(len(t or "")) / 10 for t in pdf["t"]]})

    return scoring.model_scorer("length", load, ["t"], GATE, batch_rows)


def test_model_scorer_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "abcde", 7), (2, None, 8), (3, "abcde", 9), (3, "abcde", 9)], "id long, t string, words int")
    got = gate(2)(df)
    assert sorted((r.id, r.words, r.gate) for r in got.collect()) == [(1, 7, 0.5), (2, 8, 0.0), (3, 9, 0.5), (3, 9, 0.5)]
    assert gate()(df.limit(0)).count() == 0


def test_two_stages(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "x" * 5), (3, None)], "id long, t string")
    seen = []

    def tagger(rows):
        seen.extend(r.id for r in rows.collect())
        return rows.withColumns({"tokens": F.array(F.lit("hot"), F.lit("lid"), F.lit("Lid")), "labels": F.array(F.lit("O"), F.lit("B-ASP"), F.lit("B-ASP")), "token_confidences": F.array(F.lit(0.1), F.lit(0.95), F.lit(0.5))})

    got = {r.id: [a.aspect for a in r.aspects] for r in scoring.predict_aspects(df, gate(), tagger).collect()}
    assert got == {1: ["lid"], 2: [], 3: []} and seen == [1]


def test_retries():
    calls, waits = [], []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise scoring.Busy
        return "ok"

    assert scoring.call_with_retries(call, "p", sleep=waits.append) == "ok" and waits == [4.0, 8.0]
    assert scoring.call_with_retries(lambda p: 1 / 0, "p", sleep=waits.append) is None


def test_labels_by_characters(spark):
    rows = [("The Lid  is tight, the lid holds", ["lid", None, ""]), ("a mouse pad", ["mouse pads"]), ("mouse", ["house"]), (None, ["x"]), ("a b", None)]
    df = spark.createDataFrame(rows, "s string, aspects array<string>")
    got = [None if r.ls is None else [(x.token, x.label) for x in r.ls if x.label != "O"] for r in df.select(spans.label_by_characters("s", "aspects").alias("ls")).collect()]
    assert got == [[("Lid", "B-ASP")], [("mouse", "B-ASP"), ("pad", "I-ASP")], [], [], []]


def test_labels_with_opinions(spark):
    df = spark.createDataFrame([("the big lid is big", [("big lid", "is big", 0), ("big", "", 1)]), ("", [("a", "b", 2)]), ("x", None)], "s string, t array<struct<aspect:string,opinion:string,sentiment:int>>")
    got = [r.ls for r in df.select(spans.label_with_opinions("s", "t").alias("ls")).collect()]
    assert got == [["O", "B-ASP", "I-ASP", "B-OPI-NEG", "B-ASP"], [], ["O"]]


def test_token_offsets(spark):
    text = "Don't  stop – naïve_x 3.5!"
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.token_offsets("t").alias("o")).collect()
    assert [(x.token, text[x.start : x.stop]) for x in found[0].o] == [(w, w) for w in ("Don't", "stop", "naïve_x", "3", "5")]
    assert found[1].o == [] and found[2].o is None


def test_span_sweep(spark):
    df = spark.createDataFrame([(["a", "b"], [("a", 0.9), ("c", 0.4)]), (None, [])], "g array<string>, s array<struct<aspect:string,confidence:double>>")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in metrics.span_sweep(df, "g", "s", (0.3, 0.8)).collect()}
    assert got == {0.3: (1, 1, 1), 0.8: (1, 0, 1)}


def test_split_falls_back(spark):
    df = spark.createDataFrame([(i, "lone" if i == 0 else "c") for i in range(40)], "id long, c string")
    got = sample.split_or_plain(df, ["c"], "id", [("train", 0.75), ("test", 0.25)]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 30, "test": 10}


def test_missing_files_are_named(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.warns(UserWarning, match="nowhere"):
        assert io.existing(spark, [str(tmp_path / "a"), str(tmp_path / "nowhere")], warn=True) == [str(tmp_path / "a")]
