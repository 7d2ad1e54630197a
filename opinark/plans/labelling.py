"""Queries of triplets, spans, pseudo-labels, token rules, evaluation and clusters."""

from pyspark.sql import functions as F

from opinark.functions import text as X
from opinark.operators import baselines, cluster, metrics, pseudo, spans, tokens, triplets
from opinark.plans.registry import core
from opinark.runtime import cut, name_key, table

_CAT = "translate(lower(trim(category_name)), ' -', '__')"

# Triplets stand in for hand labels: one per aspect of a row, the sentiment by its place and the rating.
_TRIPLET_SQL = """triplets AS (SELECT row_id, category_name, list_transform(range(1, len(coalesce(aspects, [])) + 1), lambda i: {'aspect': aspects[i], 'opinion': 'op ' || CAST(i AS VARCHAR), 'sentiment': CAST((coalesce(rating, 3)::INTEGER + i) % 3 AS INTEGER)}) AS triplets FROM ate_all)"""


def _triplets(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all")
    made = F.transform(
        F.coalesce("aspects", F.array().cast("array<string>")),
        lambda a, i: F.struct(a.alias("aspect"), F.concat(F.lit("op "), (i + 1).cast("string")).alias("opinion"), ((F.coalesce("rating", F.lit(3.0)).cast("int") + i + 1) % 3).cast("int").alias("sentiment")),
    )
    return rows.select("row_id", "category_name", made.alias("triplets"))


@core.query("c27_parse_triplets", "WITH " + _TRIPLET_SQL + " SELECT row_id, CAST(len(triplets) AS INTEGER) AS n, coalesce(array_to_string(list_transform(triplets, lambda t: t.aspect || '/' || t.opinion || '/' || t.sentiment), ';'), '') AS shown FROM triplets")
def c27_parse_triplets(spark, sf_dir):
    """JSON text and back: triplets written as lists and as records are both read."""
    made = _triplets(spark, sf_dir)
    as_lists = F.to_json(F.transform("triplets", lambda t: F.array(t["aspect"], t["opinion"], t["sentiment"].cast("string"))))
    text = made.select("row_id", F.when(F.col("row_id") % 2 == 0, F.to_json("triplets")).otherwise(as_lists).alias("t"))
    parsed = text.select("row_id", triplets.parse("t").alias("ts"))
    return parsed.select("row_id", F.size("ts").alias("n"), F.array_join(F.transform("ts", lambda t: F.concat_ws("/", t["aspect"], t["opinion"], t["sentiment"].cast("string"))), ";").alias("shown"))


_NAMES = "['negative', 'neutral', 'positive']"


@core.query("c35_serialize", "WITH " + _TRIPLET_SQL + f" SELECT row_id, CASE WHEN len(triplets) = 0 THEN 'none' ELSE array_to_string(list_transform(triplets, lambda t: '(' || t.aspect || ', ' || t.opinion || ', ' || {_NAMES}[t.sentiment + 1] || ')'), ' ; ') END AS shown, CAST(len(triplets) AS INTEGER) AS n_back FROM triplets WHERE list_position(list_transform(triplets, lambda t: regexp_matches(t.aspect, '[,()]')), true) IS NULL OR list_position(list_transform(triplets, lambda t: regexp_matches(t.aspect, '[,()]')), true) = 0")
def c35_serialize(spark, sf_dir):
    made = _triplets(spark, sf_dir).where(~F.exists("triplets", lambda t: F.regexp_like(t["aspect"], F.lit("[,()]"))))
    shown = made.select("row_id", triplets.serialize("triplets").alias("shown"))
    return shown.select("row_id", "shown", F.size(triplets.deserialize("shown")).alias("n_back"))


@core.query("c33_parse_pipes", "SELECT row_id, aspects[1] AS aspect, 'op' AS opinion, CAST(CAST(coalesce(rating, 3) AS INTEGER) % 3 AS INTEGER) AS sentiment FROM ate_all WHERE len(aspects) > 0 AND NOT contains(aspects[1], '|')")
def c33_parse_pipes(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where((F.size("aspects") > 0) & ~F.contains(F.get("aspects", F.lit(0)), F.lit("|")))
    names = F.array(*map(F.lit, ("neg", "Neutral ", "+1")))
    text = F.concat(F.get("aspects", F.lit(0)), F.lit(" | op|"), F.get(names, (F.coalesce("rating", F.lit(3.0)).cast("int") % 3)))
    return rows.select("row_id", triplets.parse_pipes(text).alias("t")).where("t is not null").select("row_id", "t.aspect", "t.opinion", "t.sentiment")


@core.query("f27_triplet_stats", "WITH " + _TRIPLET_SQL + f" SELECT {_CAT} AS category, count(*) AS n_rows, count(*) FILTER (WHERE len(triplets) > 0) AS n_with, count(*) FILTER (WHERE len(triplets) = 0) AS n_without, count(*) FILTER (WHERE len(triplets) > 1) AS n_multi, CAST(sum(len(triplets)) AS BIGINT) AS n_triplets, round(avg(len(triplets)), 6) AS mean_triplets, CAST(max(len(triplets)) AS BIGINT) AS most_triplets FROM triplets GROUP BY 1")
def f27_triplet_stats(spark, sf_dir):
    return triplets.stats(_triplets(spark, sf_dir).withColumn("category", name_key("category_name")), "triplets", ("category",))


@core.query("f30_category_rollup", "WITH " + _TRIPLET_SQL + f", t AS (SELECT coalesce({_CAT}, 'unknown') AS category, triplets FROM triplets) SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE len(triplets) > 0) AS n_with, count(*) FILTER (WHERE len(triplets) = 0) AS n_without, count(*) FILTER (WHERE len(triplets) > 1) AS n_multi, CAST(sum(len(triplets)) AS BIGINT) AS n_triplets, round(avg(len(triplets)), 6) AS mean_triplets, CAST(max(len(triplets)) AS BIGINT) AS most_triplets FROM t GROUP BY ROLLUP (category)")
def f30_category_rollup(spark, sf_dir):
    return triplets.stats(_triplets(spark, sf_dir).withColumn("category", F.coalesce(name_key("category_name"), F.lit("unknown"))), "triplets", ("category",), rollup=True)


_FLAT = _TRIPLET_SQL + ", flat AS (SELECT row_id, u.aspect, u.opinion, u.sentiment FROM (SELECT row_id, unnest(triplets) AS u FROM triplets))"


@core.query("j0c_flatten_triplets", "WITH " + _FLAT + " SELECT row_id, aspect, opinion, sentiment FROM flat")
def j0c_flatten_triplets(spark, sf_dir):
    return triplets.flatten(_triplets(spark, sf_dir).select("row_id", "triplets"), "triplets").select("row_id", "aspect", "opinion", "sentiment")


@core.query("f29_aspect_matrix", "WITH " + _FLAT + """, c AS (SELECT lower(trim(aspect)) AS aspect, count(*) FILTER (WHERE sentiment = 0) AS negative, count(*) FILTER (WHERE sentiment = 1) AS neutral, count(*) FILTER (WHERE sentiment = 2) AS positive FROM flat GROUP BY 1)
 SELECT *, negative + neutral + positive AS total, CASE WHEN negative >= neutral AND negative >= positive THEN 'negative' WHEN neutral >= positive THEN 'neutral' ELSE 'positive' END AS dominant FROM c""")
def f29_aspect_matrix(spark, sf_dir):
    return triplets.aspect_matrix(triplets.flatten(_triplets(spark, sf_dir).select("row_id", "triplets"), "triplets"))


@core.query("f28_top_aspects", "WITH " + _FLAT + " SELECT lower(trim(aspect)) AS aspect, count(*) AS n FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def f28_top_aspects(spark, sf_dir):
    """The twenty most frequent aspects: a top-k report."""
    flat = triplets.flatten(_triplets(spark, sf_dir).select("row_id", "triplets"), "triplets")
    return flat.groupBy(F.lower(F.trim("aspect")).alias("aspect")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "aspect").limit(20)


@core.query("f45_count_distribution", "WITH " + _TRIPLET_SQL + " SELECT CAST(len(triplets) AS INTEGER) AS n_triplets, count(*) AS n_rows FROM triplets GROUP BY 1")
def f45_count_distribution(spark, sf_dir):
    return _triplets(spark, sf_dir).groupBy(F.size("triplets").alias("n_triplets")).agg(F.count("*").alias("n_rows"))


@core.query("c37_majority_sentiment", "WITH " + _TRIPLET_SQL + ", s AS (SELECT row_id, u.sentiment FROM (SELECT row_id, unnest(triplets) AS u FROM triplets)), c AS (SELECT row_id, sentiment, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT row_id, sentiment, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, sentiment) AS rn FROM c) SELECT t.row_id, CAST(coalesce(b.sentiment, 2) AS INTEGER) AS majority FROM triplets t LEFT JOIN b ON t.row_id = b.row_id AND rn = 1")
def c37_majority_sentiment(spark, sf_dir):
    return _triplets(spark, sf_dir).select("row_id", triplets.majority(F.transform("triplets", lambda t: t["sentiment"])).cast("int").alias("majority"))


# Marking


@core.query("c21_mark_aspect", "SELECT row_id, CASE WHEN instr(lower(sentence_text), lower(a)) > 0 THEN substr(sentence_text, 1, instr(lower(sentence_text), lower(a)) - 1) || '[ASP] ' || a || ' [/ASP]' || substr(sentence_text, instr(lower(sentence_text), lower(a)) + length(a)) ELSE sentence_text || ' [ASP] ' || a || ' [/ASP]' END AS marked FROM (SELECT row_id, sentence_text, aspects[1] AS a FROM ate_all WHERE len(aspects) > 0)")
def c21_mark_aspect(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where(F.size("aspects") > 0).withColumn("a", F.get("aspects", F.lit(0)))
    return rows.select("row_id", X.mark_aspect("sentence_text", "a", append=True).alias("marked"))


@core.query("c39_context", "SELECT row_id, CASE WHEN p > 0 THEN substr(sentence_text, greatest(p - 60, 1), p + length(a) + 60 - greatest(p - 60, 1)) ELSE sentence_text END AS shown, sentence_text || ' [SEP] ' || a AS model_input FROM (SELECT row_id, sentence_text, aspects[1] AS a, instr(lower(sentence_text), lower(aspects[1])) AS p FROM ate_all WHERE len(aspects) > 0)")
def c39_context(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where(F.size("aspects") > 0).withColumn("a", F.get("aspects", F.lit(0)))
    return rows.select("row_id", X.context("sentence_text", "a").alias("shown"), X.asc_input("sentence_text", "a").alias("model_input"))


# Spans


def _labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").select("row_id", "aspects", "confidences", X.unicode_tokens("sentence_text").alias("tokens"))
    return rows.withColumn("ls", spans.label_tokens("tokens", "aspects", "confidences"))


_TOK = """tok AS (SELECT row_id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT row_id, regexp_extract_all(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?') AS t FROM ate_all)),
lab AS (SELECT *, CASE WHEN md5(token)[1] IN ('0', '1', '2', '3') THEN 'B-ASP' WHEN md5(token)[1] IN ('4', '5', '6', '7', '8') THEN 'I-ASP' ELSE 'O' END AS label, (ascii(md5(token)[2]) % 9) / 8.0 AS conf FROM tok)"""


def _md5_labels(spark, sf_dir):
    """Labels by hash of the token: every shape of label sequence occurs."""
    rows = table(spark, sf_dir, "ate_all").select("row_id", X.unicode_tokens("sentence_text").alias("tokens"))
    first = lambda t: F.substring(F.md5(t), 1, 1)
    return rows.select(
        "row_id", "tokens",
        F.transform("tokens", lambda t: F.when(first(t).isin("0", "1", "2", "3"), "B-ASP").when(first(t).isin("4", "5", "6", "7", "8"), "I-ASP").otherwise("O")).alias("labels"),
        F.transform("tokens", lambda t: (F.ascii(F.substring(F.md5(t), 2, 1)) % 9) / 8.0).alias("confs"),
    )


@core.query(
    "g8_decode_spans",
    f"""WITH {_TOK}, g AS (SELECT *, sum(CASE WHEN label <> 'I-ASP' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS grp FROM lab),
    s AS (SELECT row_id, grp, min(pos) AS start, max(pos) AS stop, arg_min(label, pos) AS head, string_agg(token, ' ' ORDER BY pos) AS aspect, avg(conf) AS conf FROM g GROUP BY 1, 2)
    SELECT row_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, aspect, round(conf, 6) AS confidence FROM s WHERE head = 'B-ASP'""",
)
def g8_decode_spans(spark, sf_dir):
    found = _md5_labels(spark, sf_dir).select("row_id", F.explode(spans.decode_spans("tokens", "labels", "confs")).alias("s"))
    return found.select("row_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.aspect").alias("aspect"), F.round("s.confidence", 6).alias("confidence"))


_BEST = f"""{_TOK}, g AS (SELECT *, sum(CASE WHEN label <> 'I-ASP' THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY pos) AS grp FROM lab),
s AS (SELECT row_id, grp, min(pos) AS start, arg_min(label, pos) AS head, string_agg(token, ' ' ORDER BY pos) AS aspect, avg(conf) AS conf FROM g GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY row_id, aspect ORDER BY conf DESC, start) AS rn FROM s WHERE head = 'B-ASP')"""


@core.query("g7_best_spans", f"WITH {_BEST} SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY conf DESC, aspect, start) - 1 AS INTEGER) AS place, aspect, round(conf, 6) AS confidence FROM best WHERE rn = 1")
def g7_best_spans(spark, sf_dir):
    found = _md5_labels(spark, sf_dir).select("row_id", F.posexplode(spans.best_spans(spans.decode_spans("tokens", "labels", "confs"))).alias("place", "s"))
    return found.select("row_id", "place", F.col("s.aspect").alias("aspect"), F.round("s.confidence", 6).alias("confidence"))


_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_LABEL_SQL = f"""n AS (SELECT row_id, aspects, confidences, list_transform(regexp_extract_all(sentence_text, '[\\p{{L}}\\p{{N}}_]+(?:''[\\p{{L}}\\p{{N}}_]+)?'), lambda t: {_NORMAL.format('t')}) AS ns FROM ate_all),
gold AS (SELECT row_id, len(known) > 0 AND len(list_filter(known, lambda c: c < 0.999)) = 0 AS gold FROM (SELECT row_id, list_filter(coalesce(confidences, []), lambda c: c IS NOT NULL AND NOT isnan(c)) AS known FROM ate_all)),
k AS (SELECT row_id, ns, unnest(range(len(coalesce(aspects, [])))) AS k, aspects, confidences FROM n),
a AS (SELECT row_id, ns, k, regexp_extract_all({_NORMAL.format('aspects[k + 1]')}, '[\\p{{L}}\\p{{N}}_]+(?:''[\\p{{L}}\\p{{N}}_]+)?') AS words, confidences[k + 1] AS conf FROM k),
placed AS (SELECT row_id, k, words, conf, ns, unnest(range(len(ns))) AS s FROM a),
h AS (SELECT row_id, k, s, len(words) AS n, conf FROM placed WHERE len(words) > 0 AND ns[s + 1:s + len(words)] = words),
pos AS (SELECT row_id, unnest(range(len(ns))) AS pos FROM n),
over_token AS (SELECT p.row_id, p.pos, arg_max(h.s, h.k * 100000 + h.s) AS s, arg_max(coalesce(h.conf, 'nan'::DOUBLE), h.k * 100000 + h.s) AS conf FROM pos p LEFT JOIN h ON h.row_id = p.row_id AND h.s <= p.pos AND p.pos < h.s + h.n GROUP BY 1, 2),
labelled AS (SELECT row_id, pos, CASE WHEN s IS NULL THEN 'O' WHEN s = pos THEN 'B-ASP' ELSE 'I-ASP' END AS label,
  CASE WHEN gold THEN 1.0 WHEN s IS NULL THEN 0.15 WHEN isnan(conf) THEN 0.6 ELSE 0.6 + (least(greatest(conf, 0.85), 1.0) - 0.85) / 0.15 * 0.3 END AS weight FROM over_token JOIN gold USING (row_id))"""


@core.query("m10_label_tokens", f"WITH {_LABEL_SQL} SELECT row_id, CAST(pos AS INTEGER) AS pos, label, round(CAST(weight AS DOUBLE), 6) AS weight FROM labelled")
def m10_label_tokens(spark, sf_dir):
    each = _labelled(spark, sf_dir).select("row_id", F.posexplode("ls").alias("pos", "l"))
    return each.select("row_id", "pos", F.col("l.label").alias("label"), F.round("l.weight", 6).alias("weight"))


@core.query("f33_label_counts")
def f33_label_counts(spark, sf_dir):
    each = _labelled(spark, sf_dir).select(F.explode("ls").alias("l")).select(F.col("l.label").alias("label"))
    return metrics.class_weights(each, "label")


@core.query(
    "f43_match_rate",
    """WITH a AS (SELECT row_id, sentence_text, unnest(aspects) AS aspect FROM ate_all), n AS (SELECT row_id,
    ' ' || array_to_string(list_transform(regexp_extract_all(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?'), lambda t: trim(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}\\s]+', '~', 'g'), '\\s+', ' ', 'g'))), ' ') || ' ' AS s,
    array_to_string(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(aspect, '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))), '[\\p{L}\\p{N}_]+'), ' ') AS w FROM a)
    SELECT count(*) AS n_aspects, count(*) FILTER (WHERE w <> '' AND NOT contains(s, ' ' || w || ' ')) AS n_unmatched FROM n""",
)
def f43_match_rate(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select(F.size("aspects").alias("n"), F.size(spans.unmatched_aspects("tokens", "aspects")).alias("missing"))
    return rows.agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_aspects"), F.sum("missing").cast("bigint").alias("n_unmatched"))


@core.query(
    "c44_token_features",
    """WITH tok AS (SELECT row_id, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT row_id, regexp_extract_all(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?') AS t FROM ate_all))
    SELECT row_id, CAST(pos AS INTEGER) AS pos, token, lower(token) AS lower, lower(coalesce(lag(token) OVER w, '<BOS>')) AS prev, lower(coalesce(lead(token) OVER w, '<EOS>')) AS next, lower(left(token, 3)) AS prefix3, lower(right(token, 3)) AS suffix3,
    token = upper(left(token, 1)) || lower(substr(token, 2)) AS is_title, regexp_matches(token, '^[0-9]+$') AS is_digit, CAST(least(pos // 5, 10) AS INTEGER) AS position_bin FROM tok WINDOW w AS (PARTITION BY row_id ORDER BY pos)""",
)
def c44_token_features(spark, sf_dir):
    return baselines.token_features(table(spark, sf_dir, "ate_all").select("row_id", X.unicode_tokens("sentence_text").alias("tokens")), "row_id", "tokens")


# Pseudo-labels


_N = "len(coalesce(aspects, []))"
_G = "CASE WHEN isnan(gate_confidence) THEN NULL ELSE gate_confidence END"
_HIGH = f"coalesce({_G} <= 0.10 OR ({_G} >= 0.90 AND {_N} >= 1), false)"


def _gated(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").withColumn("gate", F.when(~F.isnan("gate_confidence"), F.col("gate_confidence"))).withColumn("category", name_key("category_name"))
    return pseudo.split_buckets(rows, pseudo.is_ate_high("gate", F.coalesce(F.size("aspects"), F.lit(0))), "bucket")


@core.query("d7_ate_buckets", f"SELECT row_id, CASE WHEN {_HIGH} THEN 'high' ELSE 'low' END AS bucket FROM ate_all")
def d7_ate_buckets(spark, sf_dir):
    return _gated(spark, sf_dir).select("row_id", "bucket")


@core.query("d6_span_filter", f"SELECT row_id, CASE WHEN {_G} >= 0.90 THEN list_filter(confidences, lambda c: c >= 0.85 AND NOT isnan(c)) ELSE [] END AS kept FROM ate_all WHERE aspects IS NOT NULL AND confidences IS NOT NULL AND gate_confidence IS NOT NULL")
def d6_span_filter(spark, sf_dir):
    rows = _gated(spark, sf_dir).where("aspects is not null and confidences is not null and gate_confidence is not null")
    zipped = F.filter(F.transform("confidences", lambda c: F.struct(c.alias("confidence"))), lambda s: ~F.isnan(s["confidence"]))
    return rows.select("row_id", F.transform(pseudo.kept_spans(zipped, F.coalesce("gate", F.lit(0.0))), lambda s: s["confidence"]).alias("kept"))


@core.query("f25_ate_report", f"WITH b AS (SELECT {_CAT} AS category, {_N} AS n, {_HIGH} AS high FROM ate_all) SELECT category, count(*) AS n_rows, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE high AND n > 0) AS n_with_aspect, CAST(coalesce(sum(n) FILTER (WHERE high), 0) AS BIGINT) AS n_aspects, round(coalesce(n_high / n_rows, 0), 6) AS high_rate, round(coalesce(n_aspects / nullif(n_high, 0), 0), 6) AS aspects_per_high, round(coalesce(n_aspects / nullif(n_with_aspect, 0), 0), 6) AS aspects_per_positive FROM b GROUP BY 1")
def f25_ate_report(spark, sf_dir):
    return pseudo.ate_stats(_gated(spark, sf_dir), "aspects", "bucket", ("category",))


@core.query("b6_merge_buckets", f"SELECT row_id, CASE WHEN {_HIGH} THEN 'high' ELSE 'low' END AS bucket, CASE WHEN {_HIGH} THEN {_N} END AS n_aspects FROM ate_all")
def b6_merge_buckets(spark, sf_dir):
    rows = _gated(spark, sf_dir)
    high = rows.where("bucket = 'high'").select("row_id", F.coalesce(F.size("aspects"), F.lit(0)).cast("bigint").alias("n_aspects"))
    return pseudo.merge_buckets(high, rows.where("bucket = 'low'").select("row_id"), "bucket").select("row_id", "bucket", "n_aspects")


# Probabilities stand in for a model: by place and row, every class wins somewhere.
_PROB = "probs AS (SELECT row_id, list_transform(range(1, len(aspects) + 1), lambda i: CASE (row_id + i) % 4 WHEN 0 THEN [0.95, 0.03, 0.02] WHEN 1 THEN [0.2, 0.6, 0.2] WHEN 2 THEN [0.02, 0.02, 0.96] ELSE [0.1, 0.1, 0.8] END) AS sentiments FROM ate_all WHERE len(aspects) > 0)"


def _scored_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where(F.size("aspects") > 0).select("row_id", "aspects")
    each = pseudo.pairs(rows, "aspects")
    k = (F.col("row_id") + F.col("aspect_no") + 1) % 4
    p = F.when(k == 0, F.array(*map(F.lit, (0.95, 0.03, 0.02)))).when(k == 1, F.array(*map(F.lit, (0.2, 0.6, 0.2)))).when(k == 2, F.array(*map(F.lit, (0.02, 0.02, 0.96)))).otherwise(F.array(*map(F.lit, (0.1, 0.1, 0.8))))
    return pseudo.regroup(each.withColumn("p", p), "row_id", "p", "sentiments")


@core.query("d8_asc_buckets", "WITH " + _PROB + " SELECT row_id, CAST(len(sentiments) AS INTEGER) AS n, len(list_filter(sentiments, lambda p: list_max(p) < CASE WHEN p[2] >= p[1] AND p[2] >= p[3] THEN 0.55 ELSE 0.9 END)) = 0 AS high FROM probs")
def d8_asc_buckets(spark, sf_dir):
    return _scored_pairs(spark, sf_dir).select("row_id", F.size("sentiments").alias("n"), pseudo.is_asc_high("sentiments").alias("high"))


@core.query("f26_sentiments", "WITH " + _PROB + ", e AS (SELECT unnest(sentiments) AS p FROM probs), s AS (SELECT CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS sentiment, count(*) AS n FROM e GROUP BY 1) SELECT sentiment, n, round(n / (SELECT sum(n) FROM s), 6) AS share FROM s")
def f26_sentiments(spark, sf_dir):
    return pseudo.sentiment_distribution(_scored_pairs(spark, sf_dir), "sentiments")


# Evaluation: the gate score against the presence of aspects


_EVAL = "ev AS (SELECT row_id, CAST(len(aspects) > 0 AS INTEGER) AS y, gate_confidence AS s FROM ate_all WHERE aspects IS NOT NULL AND gate_confidence BETWEEN 0 AND 1 AND NOT isnan(gate_confidence))"


def _eval(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where(F.col("aspects").isNotNull() & F.col("gate_confidence").between(0, 1) & ~F.isnan("gate_confidence"))
    return rows.select("row_id", (F.size("aspects") > 0).cast("int").alias("y"), F.col("gate_confidence").alias("s"))


_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_SWEEP = f"""WITH {_EVAL}, t AS (SELECT unnest([{', '.join(map(str, _THRESHOLDS))}])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE y = 1 AND s >= threshold) AS tp, count(*) FILTER (WHERE y = 0 AND s >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND s < threshold) AS fn, count(*) FILTER (WHERE y = 0 AND s < threshold) AS tn FROM ev, t GROUP BY 1),
r AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round((tp + fp) / (tp + fp + fn + tn), 6) AS pass_rate FROM c)"""


@core.query("f36_threshold_sweep", _SWEEP + " SELECT * FROM r")
def f36_threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_eval(spark, sf_dir), "y", "s", _THRESHOLDS)


@core.query("f42_best_threshold", _SWEEP + " SELECT * FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def f42_best_threshold(spark, sf_dir):
    return metrics.best_row(f36_threshold_sweep(spark, sf_dir), "f1", "threshold")


@core.query("f37_roc_auc", f"WITH {_EVAL}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ev) SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)::DOUBLE AS auc FROM k")
def f37_roc_auc(spark, sf_dir):
    return metrics.roc_auc(_eval(spark, sf_dir), "y", "s")


# The bucket as delivered against the bucket as computed
_BUCKETS = f"bk AS (SELECT coalesce(confidence_bucket, 'none') AS y, CASE WHEN {_HIGH} THEN 'high' ELSE 'low' END AS p FROM ate_all)"


def _bucket_pairs(spark, sf_dir):
    return _gated(spark, sf_dir).select(F.coalesce("confidence_bucket", F.lit("none")).alias("y"), F.col("bucket").alias("p"))


@core.query("f38_confusion", f"WITH {_BUCKETS} SELECT y AS label, p AS predicted, count(*) AS n FROM bk GROUP BY 1, 2")
def f38_confusion(spark, sf_dir):
    return metrics.confusion(_bucket_pairs(spark, sf_dir), "y", "p")


_REPORT = f"""WITH {_BUCKETS}, l AS (SELECT y AS label FROM bk UNION SELECT p FROM bk), r AS (SELECT label, (SELECT count(*) FROM bk WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM bk WHERE y = label) AS n_true, (SELECT count(*) FROM bk WHERE p = label) AS n_predicted FROM l)"""


@core.query("f38_class_report", _REPORT + " SELECT *, round(coalesce(tp / nullif(n_predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n_true, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(n_true + n_predicted, 0), 0), 6) AS f1 FROM r")
def f38_class_report(spark, sf_dir):
    return metrics.class_report(_bucket_pairs(spark, sf_dir), "y", "p")


@core.query("f38_macro_report", _REPORT + " SELECT round(sum(tp) / sum(n_true), 6) AS accuracy, round(avg(coalesce(2 * tp / nullif(n_true + n_predicted, 0), 0)), 6) AS macro_f1, round(sum(coalesce(2 * tp / nullif(n_true + n_predicted, 0), 0) * n_true) / sum(n_true), 6) AS weighted_f1 FROM r")
def f38_macro_report(spark, sf_dir):
    return metrics.macro_report(f38_class_report(spark, sf_dir))


@core.query("f34_class_weights", f"WITH {_BUCKETS}, c AS (SELECT y, count(*) AS n FROM bk GROUP BY 1), m AS (SELECT avg(1 / sqrt(n)) AS mi, sum(n) AS t, count(*) AS k FROM c) SELECT y, n, round(least(greatest((1 / sqrt(n)) / mi, 0.25), 5.0), 6) AS inverse_sqrt, round(t / (k * n), 6) AS balanced FROM c, m")
def f34_class_weights(spark, sf_dir):
    return metrics.class_weights(_bucket_pairs(spark, sf_dir), "y")


@core.query("f35_positive_weight", f"WITH {_EVAL} SELECT round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS pos_weight FROM ev")
def f35_positive_weight(spark, sf_dir):
    return metrics.positive_weight(_eval(spark, sf_dir), "y")


@core.query("f39_set_scores", f"""WITH s AS (SELECT list_distinct(coalesce(aspects, [])) AS g, list_distinct(list_filter(coalesce(aspects, []), lambda a: ascii(md5(a)[1]) % 3 <> 0)) AS p FROM ate_all), c AS (SELECT len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM s),
t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(count(*) FILTER (WHERE fp = 0 AND fn = 0) / count(*), 6) AS exact_match FROM c) SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS jaccard FROM t""")
def f39_set_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").select("aspects", F.filter("aspects", lambda a: F.ascii(F.substring(F.md5(a), 1, 1)) % 3 != 0).alias("guess"))
    return metrics.set_scores(rows, "aspects", "guess")


# Token rules


@core.query("k8_audit_tokens")
def k8_audit_tokens(spark, sf_dir):
    """The full audit with the lexicon annotator; the nouns and adjectives are those of the aspects' field."""
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", X.normalize_sentence("sentence_text").alias("norm"))
    nouns = ("price", "quality", "screen", "battery", "story", "plot", "style", "weight", "finish", "edge", "layout", "handle", "humour", "prose", "ending", "label")
    adjectives = (*baselines.POSITIVE, *baselines.NEGATIVE, "bright", "soft", "vague", "elegant", "clumsy", "bold", "plain", "dull", "steady")
    audited = tokens.audit(tokens.annotate(rows, "norm", nouns, adjectives), "tokens", "norm")
    return audited.select("row_id", "primary_reason", "keep", "generic_token_hits", "domain_noise_hits", F.array_join("matched_patterns", "|").alias("patterns"))


@core.query("f22_pattern_counts")
def f22_pattern_counts(spark, sf_dir):
    return k8_audit_tokens(spark, sf_dir).select(F.explode_outer(F.split("patterns", r"\|")).alias("pattern")).where("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("n"))


# Vectors


@core.query("c38_l2_normalize", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / greatest(n2, 1e-12)) * (x::DOUBLE / greatest(n2, 1e-12))))), 6) AS norm FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n2 FROM embeddings)")
def c38_l2_normalize(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").withColumn("u", cluster.l2_normalize("embedding"))
    return unit.select("vec_id", F.size("u").alias("n"), F.round(F.sqrt(cluster.dot(F.col("u"), F.col("u"))), 6).alias("norm"))


@core.query("m2_nearest_centroid")
def m2_nearest_centroid(spark, sf_dir):
    """Mean vectors of the labels as fixed centroids; each row's nearest by cosine."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null")
    dims = vectors.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = dims.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centroid"))
    return cluster.nearest_centroid(vectors.select("vec_id", "embedding"), "embedding", centroids, "label", "centroid").select("vec_id", "nearest", "cosine")


@core.query("m2_kmeans")
def m2_kmeans(spark, sf_dir):
    return cluster.kmeans(table(spark, sf_dir, "embeddings").where("embedding is not null"), "embedding", 10, iterations=10).select("vec_id", "cluster_id")


@core.query("f31_cluster_sizes", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT count(*) AS n_clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median FROM c")
def f31_cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(table(spark, sf_dir, "embeddings"), "label")


# Baselines


@core.query("m12_lexicon_sentiment")
def m12_lexicon_sentiment(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews").where("text is not null and rating is not null")
    return rows.select(F.when(F.col("rating") >= 4, 2).when(F.col("rating") <= 2, 0).otherwise(1).alias("y"), baselines.lexicon_sentiment(X.tokens(F.lower("text"))).alias("p")).groupBy("y", "p").agg(F.count("*").alias("n"))


def _ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews").where("text is not null and rating is not null")
    return rows.select(X.tokens(F.lower("text")).alias("words"), F.when(F.col("rating") >= 4, 1.0).otherwise(0.0).alias("y"))


#: A fifth of the texts, by hash, is only scored; equal texts are on one side.
_HELD, _TRAIN = "pmod(xxhash64(words), 5) = 0", "pmod(xxhash64(words), 5) <> 0"


@core.query("m13_tfidf_classifier")
def m13_tfidf_classifier(spark, sf_dir):
    data = cut(_ratings(spark, sf_dir), "ratings")
    model = baselines.tfidf_classifier(data.where(_TRAIN), "words", "y")
    data = data.where(_HELD)
    grams = F.concat("words", F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 2), lambda i: i >= 0), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))))
    return model.transform(data.withColumn("_grams", grams)).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@core.query("m14_hashing_classifier")
def m14_hashing_classifier(spark, sf_dir):
    data = cut(_ratings(spark, sf_dir), "ratings")
    return baselines.hashing_classifier(data.where(_TRAIN), "words", "y").transform(data.where(_HELD)).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@core.query("f14_rating_profile", "SELECT CAST(floor(rating) AS INTEGER) AS bucket, count(*) AS n FROM seed_42 WHERE rating IS NOT NULL GROUP BY 1")
def f14_rating_profile(spark, sf_dir):
    return table(spark, sf_dir, "seed_42").where("rating is not null").groupBy(F.floor("rating").cast("int").alias("bucket")).agg(F.count("*").alias("n"))
