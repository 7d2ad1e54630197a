"""Queries of scorers, of stages made of them, and of labelling variants. The models are hashes, so that SQL gives the same scores."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark.functions import text as X
from opinark.operators import baselines, metrics, pseudo, sample, scoring, spans, triplets
from opinark.plans.labelling import _BEST, _md5_labels, _triplets
from opinark.plans.labelling import _TRIPLET_SQL
from opinark.plans.registry import core
from opinark.runtime import table

_HEX = "0123456789abcdef"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


def _digit(text: str, k: int) -> int:
    import hashlib

    return _HEX.index(hashlib.md5(text.encode()).hexdigest()[k])


def _load_parser():
    import re

    import pandas as pd

    token = re.compile(r"[^ \t\n\r\f\v]+")

    def parse(pdf):
        found = [token.findall(t or "") for t in pdf["sentence_text"]]
        return pd.DataFrame({"n_tokens": pd.Series([len(ws) for ws in found], dtype="int32"), "last": pd.Series([ws[-1] if ws else None for ws in found], dtype=object)})

    return parse


@core.query("k2_batch_parse", "SELECT row_id, CAST(len(ws) AS INTEGER) AS n_tokens, ws[-1] AS last FROM (SELECT row_id, regexp_extract_all(coalesce(sentence_text, ''), '\\S+') AS ws FROM seed_42)")
def k2_batch_parse(spark, sf_dir):
    """A parser loaded once in each worker, given 64 texts at a time (K1, K2)."""
    parse = scoring.model_scorer("white-space parser", _load_parser, ["sentence_text"], _schema(n_tokens=T.IntegerType(), last=T.StringType()), 64)
    return parse(table(spark, sf_dir, "seed_42").select("row_id", "sentence_text")).drop("sentence_text")


def _load_gate():
    import pandas as pd

    return lambda pdf: pd.DataFrame({"gate": pd.Series([None if t is None else _digit(t, 0) / 15 for t in pdf["sentence_text"]], dtype="float64")})


_GATE = "(strpos('0123456789abcdef', md5(sentence_text)[1]) - 1) / 15"


def _gate():
    return scoring.model_scorer("hash gate", _load_gate, ["sentence_text"], _schema(gate=T.DoubleType()))


@core.query("m6_gate_scores", f"SELECT row_id, CASE WHEN sentence_text IS NOT NULL THEN round({_GATE}, 6) END AS gate FROM ate_all")
def m6_gate_scores(spark, sf_dir):
    scored = _gate()(table(spark, sf_dir, "ate_all").select("row_id", "sentence_text"))
    return scored.select("row_id", F.round("gate", 6).alias("gate"))


@core.query(
    "m8_predict_aspects",
    f"""WITH {_BEST}, kept AS (SELECT row_id, list(aspect ORDER BY conf DESC, aspect, start) AS found FROM best WHERE rn = 1 AND conf >= 0.5 GROUP BY 1)
    SELECT row_id, CASE WHEN {_GATE} >= 0.7 THEN coalesce(found, []) ELSE [] END AS aspects FROM ate_all LEFT JOIN kept USING (row_id)""",
)
def m8_predict_aspects(spark, sf_dir):
    """Gate, then tagger on the rows that pass, then the best spans (M6, M7, M8)."""
    rows = table(spark, sf_dir, "ate_all").select("row_id", "sentence_text")

    def tagger(df):
        labels = _md5_labels(spark, sf_dir).withColumnRenamed("confs", "token_confidences")
        return df.join(labels, "row_id")

    found = scoring.predict_aspects(rows, _gate(), tagger, 0.7, 0.5)
    return found.select("row_id", F.transform("aspects", lambda s: s["aspect"]).alias("aspects"))


def _load_sentiment():
    import pandas as pd

    def run(pdf):
        h = [f"{s or ''}|{a}" for s, a in zip(pdf["sentence_text"], pdf["aspect"])]
        return pd.DataFrame({"probabilities": pd.Series([[_digit(x, k) / 45 for k in range(3)] for x in h], dtype=object)})

    return run


_P3 = ", ".join(f"strpos('0123456789abcdef', md5(coalesce(sentence_text, '') || '|' || aspect)[{k}]) AS d{k}" for k in (1, 2, 3))


@core.query(
    "m9_predict_sentiments",
    f"""WITH a AS (SELECT row_id, sentence_text, unnest(aspects) AS aspect, unnest(range(len(aspects))) AS k FROM ate_all), d AS (SELECT row_id, k, {_P3} FROM a),
    g AS (SELECT row_id, list(CASE WHEN d1 >= d2 AND d1 >= d3 THEN 0 WHEN d2 >= d3 THEN 1 ELSE 2 END ORDER BY k) AS classes FROM d GROUP BY 1)
    SELECT row_id, coalesce(classes, []) AS classes FROM ate_all LEFT JOIN g USING (row_id)""",
)
def m9_predict_sentiments(spark, sf_dir):
    """One row per aspect to the model, back to one array per row (M9)."""
    scorer = scoring.model_scorer("hash sentiment", _load_sentiment, ["sentence_text", "aspect"], _schema(probabilities=T.ArrayType(T.DoubleType())))
    found = scoring.predict_sentiments(table(spark, sf_dir, "ate_all").select("row_id", "sentence_text", "aspects"), "row_id", "aspects", scorer)
    return found.select("row_id", F.transform("sentiments", pseudo.argmax).alias("classes"))


def _load_service():
    import json

    seen: dict[str, int] = {}

    def call(prompt: str) -> str:
        seen[prompt] = seen.get(prompt, 0) + 1
        fails = _digit(prompt, 0) % 5  # 0 to 4 failures before an answer
        if seen[prompt] <= fails:
            raise scoring.Busy if fails % 2 else ValueError("no answer")
        seen.pop(prompt)
        return "```json\n" + json.dumps([{"aspect": "a", "opinion": "b", "sentiment": _digit(prompt, 1) % 3}]) + "\n```"

    return call


@core.query("m5_ask", "SELECT row_id, CASE WHEN (strpos('0123456789abcdef', md5('Row ' || row_id)[1]) - 1) % 5 < 3 THEN (strpos('0123456789abcdef', md5('Row ' || row_id)[2]) - 1) % 3 END AS sentiment FROM seed_42")
def m5_ask(spark, sf_dir):
    """A service that fails a few times before it answers; after three failures there is no answer (M5)."""
    rows = table(spark, sf_dir, "seed_42").select("row_id", F.concat(F.lit("Row "), F.col("row_id").cast("string")).alias("prompt"))
    answered = scoring.ask(rows, "prompt", "hash service", _load_service, sleep=lambda seconds: None)
    return answered.select("row_id", F.get(triplets.parse_response("answer"), F.lit(0))["sentiment"].alias("sentiment"))


_WORD_SQL = "'[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?'"
_CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@core.query(
    "m10d_label_characters",
    f"""WITH n AS (SELECT row_id, {_CLEAN.format('sentence_text')} AS s, aspects FROM ate_all WHERE sentence_text IS NOT NULL),
    w AS (SELECT *, regexp_extract_all(s, {_WORD_SQL}) AS ws, string_split_regex(s, {_WORD_SQL}) AS gaps FROM n),
    u AS (SELECT row_id, s, ws, gaps, unnest(range(1, len(ws) + 1)) AS k FROM w),
    t AS (SELECT row_id, k, ws[k] AS token, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda x: length(x))), 0) AS start FROM u),
    a AS (SELECT row_id, lower(s) AS low, unnest(range(len(coalesce(aspects, [])))) AS k, aspects FROM n),
    b AS (SELECT row_id, k, low, lower({_CLEAN.format('aspects[k + 1]')}) AS aspect FROM a),
    c AS (SELECT row_id, k, CASE WHEN strpos(low, aspect) > 0 THEN strpos(low, aspect) ELSE coalesce(strpos(low, nullif(regexp_extract(aspect, {_WORD_SQL}), '')), 0) END AS at, length(aspect) AS n FROM b WHERE aspect <> ''),
    o AS (SELECT t.row_id, t.k, t.token, arg_max(c.at - 1, c.k) AS s, lag(t.start) OVER (PARTITION BY t.row_id ORDER BY t.k) AS before
      FROM t LEFT JOIN c ON c.row_id = t.row_id AND c.at > 0 AND t.start >= c.at - 1 AND t.start + length(t.token) <= c.at - 1 + c.n GROUP BY t.row_id, t.k, t.token, t.start)
    SELECT row_id, CAST(k AS INTEGER) AS place, token, CASE WHEN s IS NULL THEN 'O' WHEN before IS NULL OR before < s THEN 'B-ASP' ELSE 'I-ASP' END AS label FROM o""",
)
def m10d_label_characters(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where("sentence_text is not null")
    found = rows.select("row_id", F.posexplode(spans.label_by_characters("sentence_text", "aspects")).alias("p", "l"))
    return found.select("row_id", (F.col("p") + 1).alias("place"), F.col("l.token").alias("token"), F.col("l.label").alias("label"))


@core.query(
    "m10f_label_opinions",
    f"""WITH {_TRIPLET_SQL}, n AS (SELECT t.row_id, t.triplets, regexp_extract_all(s.sentence_text, '\\S+') AS ws FROM triplets t JOIN ate_all s ON s.row_id = t.row_id WHERE s.sentence_text IS NOT NULL),
    e AS (SELECT row_id, ws, unnest(range(len(triplets))) AS k, triplets FROM n),
    p AS (SELECT row_id, ws, 2 * k AS k, regexp_extract_all(triplets[k + 1].aspect, '\\S+') AS words, 'ASP' AS tag FROM e UNION ALL
      SELECT row_id, ws, 2 * k + 1, regexp_extract_all(triplets[k + 1].opinion, '\\S+'), 'OPI-' || CASE triplets[k + 1].sentiment WHEN 2 THEN 'POS' WHEN 0 THEN 'NEG' ELSE 'NEU' END FROM e),
    placed AS (SELECT *, unnest(range(len(ws))) AS s FROM p), h AS (SELECT row_id, k, s, len(words) AS n, tag FROM placed WHERE len(words) > 0 AND ws[s + 1:s + len(words)] = words),
    pos AS (SELECT row_id, unnest(range(len(ws))) AS pos FROM n),
    o AS (SELECT p.row_id, p.pos, arg_max(h.s, h.k * 100000 + h.s) AS s, arg_max(h.tag, h.k * 100000 + h.s) AS tag FROM pos p LEFT JOIN h ON h.row_id = p.row_id AND h.s <= p.pos AND p.pos < h.s + h.n GROUP BY 1, 2)
    SELECT row_id, CAST(pos AS INTEGER) AS pos, CASE WHEN s IS NULL THEN 'O' WHEN s = pos THEN 'B-' || tag ELSE 'I-' || tag END AS label FROM o""",
)
def m10f_label_opinions(spark, sf_dir):
    rows = _triplets(spark, sf_dir).select("row_id", "triplets").join(table(spark, sf_dir, "ate_all").select("row_id", "sentence_text").where("sentence_text is not null"), "row_id")
    return rows.select("row_id", F.posexplode(spans.label_with_opinions("sentence_text", "triplets")).alias("pos", "label"))


_SWEEP = "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold"


@core.query(
    "f40_span_sweep",
    f"""WITH {_BEST}, th AS ({_SWEEP}), gold AS (SELECT row_id, list_distinct(coalesce(aspects, [])) AS g FROM ate_all),
    guess AS (SELECT row_id, threshold, list_distinct(list(aspect)) AS p FROM best, th WHERE rn = 1 AND conf >= threshold GROUP BY 1, 2),
    c AS (SELECT threshold, len(list_intersect(g, coalesce(p, []))) AS tp, len(coalesce(p, [])) - len(list_intersect(g, coalesce(p, []))) AS fp, len(g) - len(list_intersect(g, coalesce(p, []))) AS fn FROM gold CROSS JOIN th LEFT JOIN guess USING (row_id, threshold)),
    sums AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(count(*) FILTER (WHERE fp = 0 AND fn = 0) / count(*), 6) AS exact_match FROM c GROUP BY 1)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS jaccard FROM sums""",
)
def f40_span_sweep(spark, sf_dir):
    best = _md5_labels(spark, sf_dir).select("row_id", spans.best_spans(spans.decode_spans("tokens", "labels", "confs")).alias("spans"))
    rows = table(spark, sf_dir, "ate_all").select("row_id", "aspects").join(best, "row_id")
    return metrics.span_sweep(rows, "aspects", "spans", (0.25, 0.5, 0.75))


@core.query(
    "j5_split_or_plain",
    "SELECT row_id, CASE WHEN rk < round(n * 0.95) THEN 'train' ELSE 'test' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) - 1 AS rk, count(*) OVER () AS n FROM seed_42)",
)
def j5_split_or_plain(spark, sf_dir):
    """95 to 5 by a class of which one has a single row: the split falls back to no classes (J5)."""
    rows = table(spark, sf_dir, "seed_42").select("row_id")
    least = rows.agg(F.min("row_id")).first()[0]
    return sample.split_or_plain(rows.withColumn("own", F.col("row_id") == F.lit(least)), ["own"], "row_id", [("train", 0.95), ("test", 0.05)]).select("row_id", "split")


@core.query("j7_shuffled", "SELECT row_id, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) - 1 AS place FROM seed_42")
def j7_shuffled(spark, sf_dir):
    """All rows in an order as good as random, the same on every layout."""
    from opinark.sources import io

    keyed = table(spark, sf_dir, "seed_42").select("row_id", sample.hash_order("row_id").alias("h"))
    return io.slices(keyed, ["h", "row_id"], 1, "place").select("row_id", "place")


@core.query(
    "m12_learned_sentiment",
    """WITH r AS (SELECT text, CASE WHEN rating >= 4 THEN 2 WHEN rating <= 2 THEN 0 ELSE 1 END AS y, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws, contains('012', md5(text)[1]) AS held FROM reviews WHERE text IS NOT NULL AND rating IS NOT NULL),
    e AS (SELECT y, unnest(list_distinct(ws)) AS word FROM r WHERE NOT held AND y <> 1), c AS (SELECT word, count(*) FILTER (WHERE y = 2) AS p, count(*) FILTER (WHERE y = 0) AS n FROM e GROUP BY 1 HAVING count(*) >= 5),
    t AS (SELECT count(*) FILTER (WHERE y = 2) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM r WHERE NOT held), lex AS (SELECT word, round(ln((p + 1) / (np + 2)) - ln((n + 1) / (nn + 2)), 6) AS valence FROM c, t),
    d AS (SELECT DISTINCT text, ws FROM r WHERE held), u AS (SELECT text, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
    v AS (SELECT text, round(sum(CASE WHEN i > 1 AND ws[i - 1] IN ('not', 'no', 'never') THEN -valence ELSE valence END), 5) AS s FROM u JOIN lex ON lex.word = ws[i] GROUP BY 1),
    p AS (SELECT d.text, round(coalesce(s / sqrt(s * s + 15), 0), 5) AS score FROM d LEFT JOIN v USING (text))
    SELECT y, CASE WHEN score >= 0.05 THEN 2 WHEN score <= -0.05 THEN 0 ELSE 1 END AS p, count(*) AS n FROM r JOIN p USING (text) WHERE held GROUP BY 1, 2""",
)
def m12_learned_sentiment(spark, sf_dir):
    """Words get their valence from the ratings of four fifths of the texts; the others are scored."""
    rows = table(spark, sf_dir, "reviews").where("text is not null and rating is not null")
    rows = rows.select("text", F.when(F.col("rating") >= 4, 2).when(F.col("rating") <= 2, 0).otherwise(1).alias("y"), X.tokens(F.lower("text")).alias("words"))
    held = F.substring(F.md5("text"), 1, 1).isin("0", "1", "2")
    lexicon = baselines.learn_lexicon(rows.where(~held), "words", "y")
    scored = baselines.learned_sentiment(rows.where(held).select("text", "words").distinct(), "text", "words", lexicon)
    return rows.where(held).join(scored, "text").groupBy("y", F.col("sentiment").alias("p")).agg(F.count("*").alias("n"))
