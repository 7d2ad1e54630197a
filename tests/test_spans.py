import pytest
from pyspark.sql import functions as F

from opinark.operators import pseudo, spans, tokens


def labels(text):
    return [{"B": "B-ASP", "I": "I-ASP"}.get(x, x) for x in text.split()]


def decode(spark, ls):
    df = spark.createDataFrame([(labels(ls),)], "l array<string>")
    return [(s.start, s.end) for s in df.select(spans.index_spans("l").alias("s")).first().s]


def brute(ls):
    out, i = [], 0
    while i < len(ls):
        if ls[i] == "B-ASP":
            j = i
            while j + 1 < len(ls) and ls[j + 1] == "I-ASP":
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


@pytest.mark.parametrize("ls, want", [("O B I O B", [(1, 2), (4, 4)]), ("I O B I I", [(2, 4)]), ("B B I", [(0, 0), (1, 2)]), ("", []), ("O", []), ("I O B I I B O B", [(2, 4), (5, 5), (7, 7)])])
def test_index_spans(spark, ls, want):
    assert decode(spark, ls) == want


def test_index_spans_against_brute_force(spark):
    import itertools

    rows = [(list(x),) for n in range(6) for x in itertools.product(["O", "B-ASP", "I-ASP"], repeat=n)]
    df = spark.createDataFrame(rows, "l array<string>")
    for r in df.select("l", spans.index_spans("l").alias("s")).collect():
        assert [(s.start, s.end) for s in r.s] == brute(r.l)


def test_decode_and_best(spark):
    df = spark.createDataFrame([("the pen screen pen".split(), labels("O B B B"), [0.0, 0.80, 0.95, 0.95])], "t array<string>, l array<string>, c array<double>")
    got = df.select(spans.best_spans(spans.decode_spans("t", "l", "c")).alias("s")).first().s
    assert [(s.aspect, s.confidence) for s in got] == [("pen", 0.95), ("screen", 0.95)]
    multi = spark.createDataFrame([("(Battery life)!".split(), labels("B I"), [0.5, 1.0])], "t array<string>, l array<string>, c array<double>")
    assert [(s.aspect, s.confidence) for s in multi.select(spans.decode_spans("t", "l", "c").alias("s")).first().s] == [("Battery life", 0.75)]


def test_labels_and_unmatched(spark):
    df = spark.createDataFrame([("the battery life and battery life".split(), ["battery life", "pen", "life"], [0.925, 0.9, 1.0])], "t array<string>, a array<string>, c array<double>")
    row = df.select(spans.label_tokens("t", "a", "c").alias("l"), spans.label_tokens("t", "a", "c", first_only=True).alias("f"), spans.unmatched_aspects("t", "a").alias("u")).first()
    assert [x.label for x in row.l] == ["O", "B-ASP", "B-ASP", "O", "B-ASP", "B-ASP"]
    assert [round(x.weight, 6) for x in row.l] == [0.15, 0.75, 0.9, 0.15, 0.75, 0.9]
    assert [x.label for x in row.f] == ["O", "B-ASP", "B-ASP", "O", "B-ASP", "I-ASP"] or [x.label for x in row.f][4] == "O"
    assert row.u == ["pen"]
    empty = spark.createDataFrame([([], ["a"], None), (["x"], None, None)], "t array<string>, a array<string>, c array<double>")
    assert [[x.label for x in r.l] for r in empty.select(spans.label_tokens("t", "a", "c").alias("l")).collect()] == [[], ["O"]]


@pytest.mark.parametrize("conf, gold, want", [(0.85, False, 0.6), (0.925, False, 0.75), (1.0, False, 0.9), (float("nan"), False, 0.6), (0.5, False, 0.6), (0.5, True, 1.0), (None, False, 0.6)])
def test_weights(spark, conf, gold, want):
    df = spark.createDataFrame([(conf,)], "c double")
    assert df.select(spans.confidence_weight(F.col("c"), F.lit(gold)).alias("w")).first().w == pytest.approx(want)


def test_first_subtoken_and_pairs(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], list("abcde"), ["x", "y"], ["p"])], "w array<int>, v array<string>, a array<string>, o array<string>")
    row = df.select(spans.first_subtoken("w", "v").alias("f"), spans.zip_pairs("a", "o").alias("z")).first()
    assert row.f == ["b", "d"] and [(z.aspect, z.opinion) for z in row.z] == [("x", "p")]


@pytest.mark.parametrize("p, n, high", [(0.10, 0, True), (0.50, 0, False), (0.90, 0, False), (0.90, 1, True), (0.89, 1, False), (None, 1, False)])
def test_ate_buckets(spark, p, n, high):
    df = spark.createDataFrame([(p, n)], "p double, n int")
    assert df.select(pseudo.is_ate_high("p", F.col("n")).alias("h")).first().h is high


@pytest.mark.parametrize("ps, neutral, high", [([[0.01, 0.02, 0.97]], 0.6, True), ([[0.94, 0.03, 0.03]], 0.6, True), ([[0.2, 0.65, 0.15]], 0.6, True), ([[0.2, 0.57, 0.23]], 0.55, True), ([[0.2, 0.57, 0.23]], 0.6, False), ([[0.01, 0.02, 0.97], [0.5, 0.3, 0.2]], 0.55, False)])
def test_asc_buckets(spark, ps, neutral, high):
    df = spark.createDataFrame([(ps,)], "p array<array<double>>")
    assert df.select(pseudo.is_asc_high("p", neutral=neutral).alias("h")).first().h is high


def test_pairs_and_regroup(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id long, aspects array<string>")
    back = pseudo.regroup(pseudo.pairs(df, "aspects").withColumn("v", F.upper("aspect")).repartition(3), "id", "v", "vs")
    assert {r.id: r.vs for r in back.collect()} == {1: ["A", "B"], 2: ["C"]}


SENTENCE = [(0, "great", "great", "JJ", "ADJ", "amod", 1), (1, "screen", "screen", "NN", "NOUN", "nsubj", 2), (2, "is", "be", "VBZ", "AUX", "ROOT", 2), (3, "not", "not", "RB", "PART", "neg", 2), (4, "bad", "bad", "JJ", "ADJ", "acomp", 2)]


def test_token_patterns(spark):
    df = spark.createDataFrame([(SENTENCE, "great screen is not bad"), ([(0, "it", "it", "PRP", "PRON", "nsubj", 1), (1, "works", "work", "VBZ", "VERB", "ROOT", 1)], "it works"), ([], "")], f"tokens {tokens.TOKENS}, norm string")
    rows = tokens.audit(df, "tokens", "norm").collect()
    assert rows[0].matched_patterns == ["amod(adj,noun)", "nsubj(noun,opinion_predicate)", "copula_adj_noun_subject", "neg(negation,opinion_word)"]
    assert [r.primary_reason for r in rows] == ["kept", "pronoun_target_only", "too_short"]  # a pronoun is a noun phrase
    assert rows[1].flag_pronoun_target_only and not rows[0].flag_pronoun_target_only


def test_lexicon_annotator(spark):
    df = spark.createDataFrame([("the bright screen is good",), ("thing is fine",)], "norm string")
    rows = tokens.audit(tokens.annotate(df, "norm", ("screen",), ("bright", "good", "fine")), "tokens", "norm").collect()
    assert rows[0].primary_reason == "kept" and "amod(adj,noun)" in rows[0].matched_patterns
    assert rows[1].primary_reason == "all_targets_generic_or_noise" and rows[1].generic_token_hits == 1
