"""Further queries: lists as text, small scalars, filters, splits, sheets and end-to-end pairs."""

from pyspark.sql import functions as F

from opinark.functions import lists as L
from opinark.functions import text as X
from opinark.operators import baselines, clean, cluster, metrics, pseudo, spans, triplets
from opinark.operators import sample as S
from opinark.plans.labelling import _CAT, _FLAT, _TRIPLET_SQL, _labelled, _md5_labels, _triplets
from opinark.plans.registry import core
from opinark.runtime import cut, name_key, table
from opinark.sources import io


@core.query("c29b_numbers", "SELECT row_id, CAST(len(x) AS INTEGER) AS n, round(coalesce(list_sum(list_transform(x, lambda v: TRY_CAST(v AS DOUBLE))), 0), 6) AS total FROM (SELECT row_id, regexp_extract_all(coalesce(confidences, ''), '[-+]?[0-9]*\\.?[0-9]+') AS x FROM seed_42)")
def c29b_numbers(spark, sf_dir):
    x = table(spark, sf_dir, "seed_42").select("row_id", L.numbers("confidences").alias("x"))
    return x.select("row_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@core.query("c29c_quoted", "SELECT row_id, array_to_string(regexp_extract_all(coalesce(aspects, ''), '''([^'']*)''', 1), '~') AS shown FROM seed_42")
def c29c_quoted(spark, sf_dir):
    return table(spark, sf_dir, "seed_42").select("row_id", F.array_join(L.quoted("aspects"), "~").alias("shown"))


@core.query("c29d_strings")
def c29d_strings(spark, sf_dir):
    return table(spark, sf_dir, "seed_42").select("row_id", F.array_join(L.strings("aspects"), "~").alias("shown"))


@core.query("c34_distinct_aspects", "WITH f AS (SELECT row_id, unnest(aspects) AS a, unnest(range(1, len(aspects) + 1)) AS i FROM ate_all), g AS (SELECT row_id, trim(a) AS a, min(i) AS i FROM f WHERE trim(a) <> '' GROUP BY 1, 2) SELECT row_id, string_agg(a, ';' ORDER BY i) AS shown FROM g GROUP BY 1")
def c34_distinct_aspects(spark, sf_dir):
    shown = F.array_join(triplets.distinct_aspects("triplets"), ";")
    return _triplets(spark, sf_dir).select("row_id", shown.alias("shown")).where("shown <> ''")


_NAMES = {"kindle_store": "kindle", "office_products": "office", "software": "software"}


@core.query("c40_category_remap", f"SELECT row_id, CASE {_CAT} WHEN 'kindle_store' THEN 'kindle' WHEN 'office_products' THEN 'office' WHEN 'software' THEN 'software' ELSE 'electronics' END AS category FROM ate_all")
def c40_category_remap(spark, sf_dir):
    return table(spark, sf_dir, "ate_all").select("row_id", L.remap(name_key("category_name"), _NAMES, "electronics").alias("category"))


@core.query("c48_label_names", "WITH " + _FLAT + " SELECT row_id, aspect, ['negative', 'neutral', 'positive'][sentiment + 1] AS label FROM flat")
def c48_label_names(spark, sf_dir):
    flat = triplets.flatten(_triplets(spark, sf_dir).select("row_id", "triplets"), "triplets")
    return flat.select("row_id", "aspect", triplets.sentiment_name("sentiment").alias("label"))


@core.query("c49_gate_targets", "SELECT row_id, CAST(coalesce(len(aspects), 0) > 0 AS INTEGER) AS by_aspects, CAST(coalesce(gate_confidence >= 0.5 AND NOT isnan(gate_confidence), false) AS INTEGER) AS by_gate FROM ate_all")
def c49_gate_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all")
    return rows.select("row_id", (F.coalesce(F.size("aspects"), F.lit(0)) > 0).cast("int").alias("by_aspects"), F.coalesce((F.col("gate_confidence") >= 0.5) & ~F.isnan("gate_confidence"), F.lit(False)).cast("int").alias("by_gate"))


@core.query("d9_has_aspect", "SELECT row_id FROM ate_all WHERE len(aspects) > 0")
def d9_has_aspect(spark, sf_dir):
    return table(spark, sf_dir, "ate_all").where(F.size("aspects") > 0).select("row_id")


@core.query("d11_by_aspect", "WITH " + _FLAT + " SELECT DISTINCT row_id FROM flat WHERE lower(trim(aspect)) = 'plot' OR sentiment = 0")
def d11_by_aspect(spark, sf_dir):
    return _triplets(spark, sf_dir).where(triplets.with_aspect("triplets", "Plot") | triplets.with_sentiment("triplets", 0)).select("row_id")


@core.query("f46_split_totals", "SELECT lower(trim(split)) AS split, count(*) AS n, count(sentence_text) AS n_texts FROM seed_42 WHERE split IS NOT NULL GROUP BY ROLLUP (lower(trim(split)))")
def f46_split_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_42").where("split is not null").select(F.lower(F.trim("split")).alias("split"), "sentence_text")
    return rows.rollup("split").agg(F.count("*").alias("n"), F.count("sentence_text").alias("n_texts"))


@core.query("f47_validity", "WITH t AS (SELECT len(list_filter(coalesce(aspects, []), lambda a: trim(a) = '')) AS bad FROM ate_all) SELECT count(*) AS total, count(*) FILTER (WHERE bad = 0) AS valid, count(*) FILTER (WHERE bad > 0) AS invalid FROM t")
def f47_validity(spark, sf_dir):
    ok = F.forall("triplets", triplets.is_valid)
    return _triplets(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@core.query("f48_opinion_counts", "WITH " + _FLAT + " SELECT lower(opinion) AS opinion, count(*) AS n, count(DISTINCT lower(aspect)) AS n_aspects FROM flat GROUP BY 1")
def f48_opinion_counts(spark, sf_dir):
    flat = triplets.flatten(_triplets(spark, sf_dir).select("row_id", "triplets"), "triplets")
    return flat.groupBy(F.lower("opinion").alias("opinion")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("aspect")).alias("n_aspects"))


@core.query("f41_span_scores")
def f41_span_scores(spark, sf_dir):
    """Spans of the labelled aspects against spans of the labels by hash."""
    gold = _labelled(spark, sf_dir).select("row_id", spans.index_spans(F.transform("ls", lambda x: x["label"])).alias("g"))
    guess = _md5_labels(spark, sf_dir).select("row_id", spans.index_spans("labels").alias("p"))
    return metrics.span_scores(gold.join(guess, "row_id"), "g", "p")


@core.query("f41_token_scores")
def f41_token_scores(spark, sf_dir):
    gold = _labelled(spark, sf_dir).select("row_id", F.transform("ls", lambda x: x["label"]).alias("g"))
    return metrics.token_scores(gold.join(_md5_labels(spark, sf_dir).select("row_id", F.col("labels").alias("p")), "row_id"), "g", "p")


@core.query("g4_aspect_positions", "SELECT row_id, unnest(aspects) AS aspect, CAST(unnest(range(1, len(aspects) + 1)) AS INTEGER) AS place FROM ate_all")
def g4_aspect_positions(spark, sf_dir):
    each = pseudo.pairs(table(spark, sf_dir, "ate_all").select("row_id", "aspects"), "aspects")
    return each.select("row_id", "aspect", (F.col("aspect_no") + 1).cast("int").alias("place"))


@core.query("h4_longest_texts", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100")
def h4_longest_texts(spark, sf_dir):
    """The hundred longest documents: a top-k report."""
    return table(spark, sf_dir, "documents").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(100).select("doc_id", "n_chars")


@core.query("h5_first_rows", "SELECT row_id FROM reviews_cleaning2 ORDER BY review_id NULLS FIRST, sentence_id NULLS FIRST, row_id LIMIT 1000")
def h5_first_rows(spark, sf_dir):
    """The max-rows operator: the first thousand rows by review and position."""
    return table(spark, sf_dir, "reviews_cleaning2").orderBy("review_id", "sentence_id", "row_id").limit(1000).select("row_id")


@core.query("i4_distinct_items", "SELECT DISTINCT nullif(upper(trim(parent_asin)), '') AS item FROM reviews_cleaning2")
def i4_distinct_items(spark, sf_dir):
    from opinark.runtime import item_key

    return table(spark, sf_dir, "reviews_cleaning2").select(item_key("parent_asin").alias("item")).distinct()


@core.query("i7_gold_and_pseudo", "SELECT 'gold' AS origin, row_id, split, CAST(NULL AS VARCHAR) AS confidence_bucket FROM seed_42 UNION ALL SELECT 'pseudo', row_id, NULL, confidence_bucket FROM ate_all")
def i7_gold_and_pseudo(spark, sf_dir):
    gold = table(spark, sf_dir, "seed_42").select(F.lit("gold").alias("origin"), "row_id", "split")
    return gold.unionByName(table(spark, sf_dir, "ate_all").select(F.lit("pseudo").alias("origin"), "row_id", "confidence_bucket"), allowMissingColumns=True)


@core.query("b9_label_sheets", "SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS slice_no FROM seed_42")
def b9_label_sheets(spark, sf_dir):
    return io.slices(table(spark, sf_dir, "seed_42").select("row_id"), ["row_id"], 100).select("row_id", "slice_no")


@core.query("b11_report", "SELECT 'ATE stage' AS line UNION ALL SELECT 'n_rows: ' || count(*) FROM ate_all UNION ALL SELECT 'n_items: ' || count(DISTINCT parent_asin) FROM ate_all")
def b11_report(spark, sf_dir):
    stats = table(spark, sf_dir, "ate_all").agg(F.count("*").alias("n_rows"), F.count_distinct("parent_asin").alias("n_items"))
    return io.report_lines(stats, "ATE stage")


@core.query("b13_pending", "SELECT DISTINCT nullif(upper(trim(parent_asin)), '') AS item FROM reviews_cleaning2 WHERE nullif(upper(trim(parent_asin)), '') NOT IN (SELECT upper(trim(parent_asin)) FROM seed_42 WHERE parent_asin IS NOT NULL)")
def b13_pending(spark, sf_dir):
    from opinark.runtime import item_key

    items = table(spark, sf_dir, "reviews_cleaning2").select(item_key("parent_asin").alias("item")).where("item is not null").distinct()
    done = table(spark, sf_dir, "seed_42").select(item_key("parent_asin").alias("item")).where("item is not null")
    return io.pending(items, done, ["item"])


@core.query("j6_three_way_split", "WITH t AS (SELECT row_id, CAST(coalesce(rating, 3) AS INTEGER) AS s FROM seed_42), r AS (SELECT row_id, row_number() OVER (PARTITION BY s ORDER BY md5(row_id || ':7'), row_id) - 1 AS rk, count(*) OVER (PARTITION BY s) AS n FROM t) SELECT row_id, CASE WHEN rk < round(n * 0.8) THEN 'train' WHEN rk < round(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM r")
def j6_three_way_split(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_42").select("row_id", F.coalesce("rating", F.lit(3.0)).cast("int").alias("s"))
    return S.stratified_split(rows, ["s"], "row_id", [("train", 0.8), ("validation", 0.1), ("test", 0.1)], seed=7).select("row_id", "split")


@core.query("j0e_explode_outer", "SELECT row_id, a AS aspect FROM ate_all LEFT JOIN LATERAL (SELECT unnest(aspects) AS a) ON true")
def j0e_explode_outer(spark, sf_dir):
    return table(spark, sf_dir, "ate_all").select("row_id", F.explode_outer("aspects").alias("aspect"))


@core.query("m5_parse_responses", "WITH " + _TRIPLET_SQL + ", e AS (SELECT row_id, unnest(triplets) AS t FROM triplets) SELECT row_id, t.aspect, t.opinion, t.sentiment FROM e")
def m5_parse_responses(spark, sf_dir):
    """Answers as models write them: fenced, with talk around, or bare."""
    body = F.to_json("triplets")
    text = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit("Here you are: "), body, F.lit(" Anything else?"))).otherwise(body)
    return _triplets(spark, sf_dir).select("row_id", F.explode(triplets.parse_response(text)).alias("t")).select("row_id", "t.aspect", "t.opinion", "t.sentiment")


@core.query("m1_text_vectors")
def m1_text_vectors(spark, sf_dir):
    """Unit vectors of hashed words, and the clusters that k-means finds in them."""
    from pyspark.ml.functions import vector_to_array

    rows = table(spark, sf_dir, "seed_42").where("sentence_text is not null").select("row_id", X.tokens(F.lower("sentence_text")).alias("words"))
    vectors = cluster.hashed_text_vectors(rows, "words", 64).select("row_id", vector_to_array("features").alias("v"))
    return cluster.kmeans(cut(vectors, "vectors"), "v", 20, iterations=10).select("row_id", "cluster_id")


@core.query("m11_pairs_by_place", "SELECT row_id, unnest(list_zip(aspects[1:least(len(aspects), len(confidences))], confidences[1:least(len(aspects), len(confidences))]))[1] AS aspect, CAST(unnest(range(1, least(len(aspects), len(confidences)) + 1)) AS INTEGER) AS place FROM ate_all WHERE confidences IS NOT NULL AND aspects IS NOT NULL")
def m11_pairs_by_place(spark, sf_dir):
    rows = table(spark, sf_dir, "ate_all").where("aspects is not null and confidences is not null")
    zipped = rows.select("row_id", F.posexplode(spans.zip_pairs("aspects", F.transform("confidences", lambda c: c.cast("string")))).alias("p", "z"))
    return zipped.select("row_id", F.col("z.aspect").alias("aspect"), (F.col("p") + 1).cast("int").alias("place"))


@core.query("m15_token_tagger")
def m15_token_tagger(spark, sf_dir):
    """A token tagger learnt from the labelled aspects; counts of label and prediction."""
    rows = table(spark, sf_dir, "ate_all").where(F.size("aspects") > 0).select("row_id", X.unicode_tokens("sentence_text").alias("tokens"), "aspects")
    labels = rows.select("row_id", F.posexplode(spans.label_tokens("tokens", "aspects")).alias("pos", "l")).select("row_id", "pos", F.col("l.label").alias("label"))
    data = cut(baselines.token_features(rows, "row_id", "tokens").join(labels, ["row_id", "pos"]), "token-features")
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0  # a fifth of the sentences is only scored
    model = baselines.token_tagger(data.where(~held), "label", 1 << 12)
    data = data.where(held)
    names = ["lower", "prev", "next", "prefix3", "suffix3", "is_title", "is_digit", "position_bin"]
    return model.transform(data.select("*", *(F.col(c).cast("string").alias(f"_{c}") for c in names))).groupBy("label", F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@core.query("m16_pair_scores")
def m16_pair_scores(spark, sf_dir):
    """End to end: aspect and sentiment pairs of gold rows against lexicon sentiment on the same aspects."""
    rows = _triplets(spark, sf_dir).join(table(spark, sf_dir, "ate_all").select("row_id", X.tokens(F.lower("sentence_text")).alias("words")), "row_id")
    guess = baselines.lexicon_sentiment("words")
    pair = lambda t, s: F.concat_ws("|", F.lower(t["aspect"]), s.cast("string"))
    scored = rows.withColumn("guess", guess).select(F.transform("triplets", lambda t: pair(t, t["sentiment"])).alias("g"), F.transform("triplets", lambda t: pair(t, F.col("guess"))).alias("p"))
    return metrics.set_scores(scored, "g", "p")


@core.query("a4_fixed_projection", "SELECT parent_asin, CAST(review_id AS VARCHAR) AS review_id, CAST(NULL AS BIGINT) AS sentence_id, CAST(NULL AS VARCHAR) AS sentence_text, rating FROM reviews")
def a4_fixed_projection(spark, sf_dir):
    from opinark import schemas

    return schemas.conform(table(spark, sf_dir, "reviews"), schemas.SENTENCES)


@core.query("h6_length_order")
def h6_length_order(spark, sf_dir):
    """A batch scorer that gets texts of like length together: here it returns the padding each batch would need."""
    rows = table(spark, sf_dir, "seed_42").where("sentence_text is not null").select("row_id", "sentence_text", F.length("sentence_text").alias("n"))

    def score(pdf):
        import pandas as pd

        return pd.DataFrame({"row_id": pdf["row_id"], "padding": (pdf["n"].max() - pdf["n"]).astype("int32")})

    return io.map_batches(rows, score, "row_id long, padding int", "n")


@core.query("j0a_stage_statistics", "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s.!?]', ' ', 'g'), '\\s+', ' ', 'g')), '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL) SELECT count(*) AS n_docs, CAST(sum(len(parts)) AS BIGINT) AS n_sentences, round(avg(len(parts)), 6) AS per_doc FROM s")
def j0a_stage_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.whitelist_lower("text").alias("text"))
    counts = clean.split_marks(docs, "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sentences"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("per_doc"))
