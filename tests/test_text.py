import pytest
from pyspark.sql import functions as F

from opinark.functions import text as X
from opinark.operators import clean


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()
    return row.v


@pytest.mark.parametrize("t, x, concat, merged", [(None, "B", "B", "B"), ("", "B", " B", "B"), ("A", "B", "A B", "A. B"), ("  ", "ok", "   ok", "ok"), ("A", None, "A", "A"), (None, None, "", "")])
def test_merging(spark, t, x, concat, merged):
    assert one(spark, X.concat_text("t", "x"), t=t, x=x) == concat
    assert one(spark, X.merge_text("t", "x"), t=t, x=x) == merged


@pytest.mark.parametrize(
    "f, text, want",
    [
        (X.whitelist_lower, "Great!! Works, 100%.", "great!! works 100 ."),
        (X.whitelist_keep_case, "Great!! Works, 100%.", "Great!! Works 100."),
        (X.whitelist_unicode, "Great!! Works, 100%.", "great!! works 100."),
        (X.whitelist_unicode, "Très  bon — ça marche", "très bon  ça marche"),
        (X.expand_substrings, "they won't", "they will not"),
        (X.expand_substrings, "ain't", "ai not"),
        (X.expand_substrings, "dog's", "dog's"),
        (X.expand_words, "ain't", "is not"),
        (X.expand_words, "I can't've; 'tis the dog's", "i can not have; 'tis the dog's"),
        (X.normalize_sentence, "I can’t  believe it's GREAT!!", "i can not believe it is great"),
        (X.normalize_sentence, None, ""),
        (X.normalize_sentence, "NaN", ""),
        (X.tag_lexicon, "the product came in a box", "the [GENERIC_NOUN] came in a [DOMAIN_NOISE]"),
        (X.tag_lexicon, "'things'", "[GENERIC_NOUN]"),
        (X.normalize_span, " (screen)! ", "screen"),
        (X.clean_html, "a<br/>b ﬁne “x”", "a b fine x"),
        (X.clean_gold, "the [GENERIC_NOUN] is<br />br  good", "the is good"),
        (X.drop_br, "a br b brown", "a b brown"),
        (lambda c: X.normalize_aspect(c, "ascii"), "Big Screen", "ig creen"),
        (lambda c: X.normalize_aspect(c, "unicode"), "Big_Screen (L)", "big screen l"),
        (lambda c: X.normalize_aspect(c, "gold"), "Big_Screen (L)", "big screen l"),
        (X.clean_text, None, ""),
        (lambda c: X.fill_blank(c, "d"), "  ", "d"),
        (X.whitelist_lower, None, None),
    ],
)
def test_functions(spark, f, text, want):
    assert one(spark, f("c"), c=text) == want


@pytest.mark.parametrize("text, short", [("ab c", True), ("hello", True), ("ok good", False)])
def test_short(spark, text, short):
    assert one(spark, X.is_too_short("c"), c=text) is short


@pytest.mark.parametrize("text, social", [("thanks so much", True), ("best regards", True), ("thanks for the pen", False)])
def test_social(spark, text, social):
    assert one(spark, X.is_social("c"), c=text) is social


@pytest.mark.parametrize(
    "s, a, append, want",
    [
        ("The Battery life is good", "battery LIFE", False, "The [ASP] battery LIFE [/ASP] is good"),
        ("good", "screen", False, "good"),
        ("good", "screen", True, "good [ASP] screen [/ASP]"),
        ("a screen, a screen", "screen", False, "a [ASP] screen [/ASP], a screen"),
    ],
)
def test_marks(spark, s, a, append, want):
    assert one(spark, X.mark_aspect("s", "a", append), s=s, a=a) == want


def test_percent_and_context(spark):
    df = spark.range(1)
    assert df.select(X.percent_text(F.lit(1), F.lit(3)).alias("v")).first().v == "1 (33.33%)"
    assert df.select(X.percent_text(F.lit(0), F.lit(0)).alias("v")).first().v == "0 (0.00%)"
    assert one(spark, X.context("s", "a", 3), s="abcdefghij", a="E") == "bcdefgh"


def test_word_deletion_is_stable(spark):
    rows = [(i, "one two three four five six seven") for i in range(200)] + [(900, "a b c")]
    df = spark.createDataFrame(rows, "id long, t string")
    a, b = ({r.id: r.v for r in d.select("id", X.delete_words("t", F.col("id")).alias("v")).collect()} for d in (df, df.repartition(7)))
    assert a == b and a[900] == "a b c"
    lost = sum(7 - len(v.split()) for k, v in a.items() if k != 900)
    assert 120 < lost < 310


def test_splitting_and_renumbering(spark):
    df = spark.createDataFrame([(1, "great!! works 100 ."), (2, "..."), (3, None)], "id long, t string")
    got = [(r.id, r.sentence_id, r.sentence_text) for r in clean.split_marks(df, "t").orderBy("id", "sentence_id").collect()]
    assert got == [(1, 1, "great"), (1, 2, "works 100")]
    kept = clean.renumber(spark.createDataFrame([("r", 9, "b"), ("r", 4, "a"), ("q", 1, "c")], "k string, n int, t string"), "k", ["n"])
    assert {(r.t, r.sentence_id) for r in kept.collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_first_of_is_the_smallest_by_order(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("k", 2, "b"), (None, 1, "n"), (None, 0, "m")], "k string, n int, v string")
    assert {(r.k, r.v) for r in clean.first_of(df, ["k"], ["n"]).collect()} == {("k", "a"), (None, "m")}


def test_cascade_takes_the_first_rule(spark):
    df = spark.range(4)
    got = df.select(clean.first_reason([("a", F.col("id") < 1), ("b", F.col("id") < 2)]).alias("v")).collect()
    assert [r.v for r in got] == ["a", "b", "kept", "kept"]


def test_text_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("x",)], "c string").select(X.normalize_sentence("c").alias("n")).select(X.tag_lexicon("n"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
