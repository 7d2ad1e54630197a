"""Queries of profiles, joins, aggregates, windows, sets and samples over reviews and item data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from opinark.operators import profile as P
from opinark.operators import sample as S
from opinark.plans.registry import core
from opinark.runtime import item_key, lookup_join, name_key, table

_ITEM = "nullif(upper(trim({0})), '')"


def _t(name):
    return lambda spark, d: table(spark, d, name)


# Profiles


def _null_sql(name, columns):
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS total FROM {name}" for c in columns)
    return f'SELECT "column", nulls, total, round(nulls * 100.0 / total, 6)::DOUBLE AS percent FROM ({each})'


_REVIEW_COLUMNS = ("review_id", "parent_asin", "asin", "user_id", "rating", "title", "text", "review_ms", "helpful_vote", "verified_purchase", "ingested_at")
_META_COLUMNS = ("parent_asin", "main_category", "title", "store", "average_rating", "rating_number", "price", "features", "categories", "details", "author")


@core.query("f9_null_profile_reviews", _null_sql("reviews", _REVIEW_COLUMNS))
def f9_null_profile_reviews(spark, sf_dir):
    return P.null_profile(table(spark, sf_dir, "reviews").select(*_REVIEW_COLUMNS))


@core.query("f9_null_profile_meta", _null_sql("item_meta", _META_COLUMNS))
def f9_null_profile_meta(spark, sf_dir):
    return P.null_profile(table(spark, sf_dir, "item_meta").select(*_META_COLUMNS))


@core.query("f10_nan_profile", 'SELECT "column", nans, total, round(nans * 100.0 / total, 6)::DOUBLE AS percent FROM (SELECT \'rating\' AS "column", count(*) FILTER (WHERE isnan(rating)) AS nans, count(*) AS total FROM ate_all UNION ALL SELECT \'gate_confidence\', count(*) FILTER (WHERE isnan(gate_confidence)), count(*) FROM ate_all)')
def f10_nan_profile(spark, sf_dir):
    return P.nan_profile(table(spark, sf_dir, "ate_all"))


@core.query("f11_empty_list_profile", 'SELECT "column", empty, total, round(empty * 100.0 / total, 6)::DOUBLE AS percent FROM (SELECT \'features\' AS "column", count(*) FILTER (WHERE len(features) = 0) AS empty, count(*) AS total FROM item_meta UNION ALL SELECT \'categories\', count(*) FILTER (WHERE len(categories) = 0), count(*) FROM item_meta)')
def f11_empty_list_profile(spark, sf_dir):
    return P.empty_list_profile(table(spark, sf_dir, "item_meta"))


def _describe_sql(c):
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest FROM reviews"


@core.query("f12_describe", f"{_describe_sql('rating')} UNION ALL {_describe_sql('helpful_vote')}")
def f12_describe(spark, sf_dir):
    return P.describe(table(spark, sf_dir, "reviews"), ["rating", "helpful_vote"])


@core.query("f13_exact_quantiles", "SELECT q AS quantile, round(v, 6) AS value FROM (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q, unnest(quantile_cont(length(text)::DOUBLE, [0.25, 0.5, 0.75, 0.9, 0.99])) AS v FROM reviews)")
def f13_exact_quantiles(spark, sf_dir):
    return P.exact_quantiles(table(spark, sf_dir, "reviews").select(F.length("text").cast("double").alias("n")), "n", [0.25, 0.5, 0.75, 0.9, 0.99])


@core.query("f13_approx_quantiles")
def f13_approx_quantiles(spark, sf_dir):
    return P.approx_quantiles(table(spark, sf_dir, "reviews").select(F.length("text").alias("n")), "n", [0.25, 0.5, 0.75, 0.9, 0.99])


@core.query(
    "f14_length_histogram",
    """WITH v AS (SELECT length(text)::DOUBLE AS n FROM reviews WHERE text IS NOT NULL), e AS (SELECT min(n) AS lo, max(n) AS hi FROM v)
    SELECT CAST(least(floor((n - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bucket, round(lo + (bucket - 1) * ((hi - lo) / 20), 6) AS low, round(lo + bucket * ((hi - lo) / 20), 6) AS high, count(*) AS n FROM v, e GROUP BY bucket, lo, hi""".replace(
        "count(*) AS n FROM v, e GROUP BY bucket, lo, hi", "count(*) AS n FROM v, e GROUP BY ALL"
    ).replace("SELECT CAST(least(floor((n - lo)", "SELECT CAST(least(floor((v.n - lo)"),
)
def f14_length_histogram(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "reviews").select(F.length("text").alias("len")), "len", 20)


@core.query("f15_rating_buckets", "SELECT CAST(CASE WHEN rating = 6 THEN 5 ELSE floor(rating) END AS INTEGER) AS bucket, count(*) AS n FROM reviews WHERE rating IS NOT NULL AND rating BETWEEN 0 AND 6 GROUP BY 1")
def f15_rating_buckets(spark, sf_dir):
    return table(spark, sf_dir, "reviews").select(P.bucketize("rating", [0, 1, 2, 3, 4, 5, 6]).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@core.query("f16_duplicate_keys", "SELECT asin, user_id, review_ms, count(*) AS n FROM reviews GROUP BY ALL HAVING count(*) > 1")
def f16_duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(table(spark, sf_dir, "reviews"), ["asin", "user_id", "review_ms"])


@core.query("f17_key_uniqueness", "SELECT count(*) AS total, count(DISTINCT parent_asin) AS distinct_keys, count(*) = count(DISTINCT parent_asin) AS is_unique FROM item_meta")
def f17_key_uniqueness(spark, sf_dir):
    return P.key_uniqueness(table(spark, sf_dir, "item_meta"), ["parent_asin"])


@core.query("f18_singleton_users", "WITH c AS (SELECT user_id, count(*) AS n FROM reviews WHERE user_id IS NOT NULL GROUP BY 1) SELECT count(*) AS n_keys, count(*) FILTER (WHERE n = 1) AS n_single, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS share FROM c")
def f18_singleton_users(spark, sf_dir):
    return P.singleton_share(table(spark, sf_dir, "reviews"), "user_id")


@core.query("f19_json_fields", "WITH k AS (SELECT unnest(json_keys(props)) AS field FROM events WHERE props IS NOT NULL) SELECT field, count(*) AS n FROM k GROUP BY 1")
def f19_json_fields(spark, sf_dir):
    return P.json_field_paths(table(spark, sf_dir, "events"), "props")


@core.query("c30_details_fields")
def c30_details_fields(spark, sf_dir):
    return P.json_field_paths(table(spark, sf_dir, "item_meta"), "details")


@core.query("h2_category_counts", "SELECT translate(lower(trim(category_name)), ' -', '__') AS category, count(*) AS n FROM reviews_cleaning2 GROUP BY 1")
def h2_category_counts(spark, sf_dir):
    return table(spark, sf_dir, "reviews_cleaning2").groupBy(name_key("category_name").alias("category")).agg(F.count("*").alias("n"))


# Joins


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "reviews").withColumn("item", item_key("parent_asin"))


def _meta(spark, sf_dir, *columns):
    return table(spark, sf_dir, "item_meta").select(F.col("parent_asin").alias("item"), *columns)


@core.query("e1_left_join", f"SELECT r.review_id, r.parent_asin, m.store, m.average_rating FROM reviews r LEFT JOIN item_meta m ON {_ITEM.format('r.parent_asin')} = m.parent_asin")
def e1_left_join(spark, sf_dir):
    return lookup_join(_keyed(spark, sf_dir).select("review_id", "parent_asin", "item"), _meta(spark, sf_dir, "store", "average_rating"), ["item"], "left").select("review_id", "parent_asin", "store", "average_rating")


@core.query("e2_join_coverage", f"SELECT count(*) FILTER (WHERE k IN (SELECT parent_asin FROM item_meta WHERE price > 0)) AS matched, count(*) FILTER (WHERE k IS NULL OR k NOT IN (SELECT parent_asin FROM item_meta WHERE price > 0)) AS unmatched FROM (SELECT {_ITEM.format('parent_asin')} AS k FROM reviews)")
def e2_join_coverage(spark, sf_dir):
    return P.join_coverage(_keyed(spark, sf_dir), table(spark, sf_dir, "item_meta").where("price > 0").select(F.col("parent_asin").alias("item")), "item")


@core.query("e3_top_items", f"WITH c AS (SELECT {_ITEM.format('parent_asin')} AS item, count(*) AS n_reviews FROM reviews WHERE {_ITEM.format('parent_asin')} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT c.item, n_reviews, title FROM c LEFT JOIN item_meta m ON c.item = m.parent_asin")
def e3_top_items(spark, sf_dir):
    """The five items with most reviews: a top-k report."""
    top = _keyed(spark, sf_dir).where("item is not null").groupBy("item").agg(F.count("*").alias("n_reviews")).orderBy(F.desc("n_reviews"), "item").limit(5)
    return _meta(spark, sf_dir, "title").join(F.broadcast(top), "item", "right").select("item", "n_reviews", "title")


@core.query("e4_rating_gap", f"WITH c AS (SELECT {_ITEM.format('parent_asin')} AS item, count(*) AS n, avg(rating) AS mean FROM reviews WHERE {_ITEM.format('parent_asin')} IS NOT NULL GROUP BY 1 HAVING count(*) > 10) SELECT item, n, round(mean, 6) AS mean, average_rating, round(mean - average_rating, 6) AS gap FROM c LEFT JOIN item_meta m ON c.item = m.parent_asin")
def e4_rating_gap(spark, sf_dir):
    c = _keyed(spark, sf_dir).where("item is not null").groupBy("item").agg(F.count("*").alias("n"), F.avg("rating").alias("m")).where("n > 10")
    return c.join(_meta(spark, sf_dir, "average_rating"), "item", "left").select("item", "n", F.round("m", 6).alias("mean"), "average_rating", F.round(F.col("m") - F.col("average_rating"), 6).alias("gap"))


@core.query("e5_right_join_time", "WITH a AS (SELECT review_ms, count(*) AS n FROM reviews WHERE rating <= 2 GROUP BY 1), b AS (SELECT DISTINCT review_ms FROM reviews WHERE review_ms IS NOT NULL) SELECT b.review_ms, a.n FROM a RIGHT JOIN b ON a.review_ms = b.review_ms")
def e5_right_join_time(spark, sf_dir):
    r = table(spark, sf_dir, "reviews")
    a = r.where("rating <= 2").groupBy("review_ms").agg(F.count("*").alias("n"))
    return a.join(r.where("review_ms is not null").select("review_ms").distinct(), "review_ms", "right").select("review_ms", "n")


@core.query("e6_label_lookup", "SELECT c.row_id, coalesce(s.aspects, '[]') AS aspects FROM reviews_cleaning2 c LEFT JOIN (SELECT upper(trim(parent_asin)) AS item, sentence_id, min(aspects) AS aspects FROM seed_42 GROUP BY 1, 2) s ON upper(trim(c.parent_asin)) = s.item AND c.sentence_id = s.sentence_id")
def e6_label_lookup(spark, sf_dir):
    labels = table(spark, sf_dir, "seed_42").groupBy(F.upper(F.trim("parent_asin")).alias("item"), "sentence_id").agg(F.min("aspects").alias("aspects"))
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", F.upper(F.trim("parent_asin")).alias("item"), "sentence_id")
    return lookup_join(rows, labels, ["item", "sentence_id"], "left").select("row_id", F.coalesce("aspects", F.lit("[]")).alias("aspects"))


def _leak_sql(key):
    return f"SELECT row_id FROM seed_42 s WHERE lower(trim(split)) = 'train' AND NOT EXISTS (SELECT 1 FROM seed_42 t WHERE lower(trim(t.split)) = 'test' AND {key.format('t')} = {key.format('s')})"


def _leak(normalize):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "seed_42").withColumn("part", F.lower(F.trim("split")))
        return S.leak_free(rows.where("part = 'train'"), rows.where("part = 'test'"), "sentence_text", normalize).select("row_id")

    return run


core.query("e7_leak_free_exact", _leak_sql("{0}.sentence_text"))(_leak(False))
core.query("e7_leak_free_normalized", _leak_sql("lower(trim({0}.sentence_text))"))(_leak(True))


# Aggregates


@core.query("f1_counts", "SELECT count(*) AS n, count(DISTINCT review_id) AS n_reviews, count(DISTINCT user_id) AS n_users FROM reviews")
def f1_counts(spark, sf_dir):
    return table(spark, sf_dir, "reviews").agg(F.count("*").alias("n"), F.count_distinct("review_id").alias("n_reviews"), F.count_distinct("user_id").alias("n_users"))


@core.query("f4_item_stats", f"SELECT {_ITEM.format('parent_asin')} AS item, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM reviews GROUP BY 1")
def f4_item_stats(spark, sf_dir):
    return _keyed(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@core.query("f4_user_stats", "SELECT user_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, CAST(sum(helpful_vote) AS BIGINT) AS votes FROM reviews GROUP BY 1")
def f4_user_stats(spark, sf_dir):
    return table(spark, sf_dir, "reviews").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.sum("helpful_vote").alias("votes"))


_MS = "CASE WHEN review_ms < 1 THEN NULL WHEN review_ms < 100000000000 THEN review_ms * 1000 ELSE review_ms END"
_TS = f"epoch_ms({_MS})"


@core.query("c24_time_parts", f"SELECT review_id, parent_asin, CAST({_TS} AS DATE) AS day, CAST(year({_TS}) AS INTEGER) AS year, CAST(month({_TS}) AS INTEGER) AS month, CAST(day({_TS}) AS INTEGER) AS day_of_month FROM reviews")
def c24_time_parts(spark, sf_dir):
    parts = P.time_parts("review_ms")
    return table(spark, sf_dir, "reviews").select("review_id", "parent_asin", *(parts[k].alias(k) for k in ("day", "year", "month", "day_of_month")))


@core.query("f5_by_month", f"SELECT CAST(year({_TS}) AS INTEGER) AS year, CAST(month({_TS}) AS INTEGER) AS month, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM reviews GROUP BY 1, 2")
def f5_by_month(spark, sf_dir):
    parts = P.time_parts("review_ms")
    return table(spark, sf_dir, "reviews").groupBy(parts["year"].alias("year"), parts["month"].alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@core.query("f6_by_day", f"SELECT CAST({_TS} AS DATE) AS day, count(*) AS n FROM reviews GROUP BY 1")
def f6_by_day(spark, sf_dir):
    return table(spark, sf_dir, "reviews").groupBy(P.time_parts("review_ms")["day"].alias("day")).agg(F.count("*").alias("n"))


@core.query("f7_conditional_averages", f"SELECT {_ITEM.format('parent_asin')} AS item, round(avg(rating) FILTER (WHERE verified_purchase), 6) AS verified, round(avg(rating) FILTER (WHERE NOT verified_purchase), 6) AS unverified FROM reviews GROUP BY 1")
def f7_conditional_averages(spark, sf_dir):
    return _keyed(spark, sf_dir).groupBy("item").agg(F.round(F.avg(F.when(F.col("verified_purchase"), F.col("rating"))), 6).alias("verified"), F.round(F.avg(F.when(~F.col("verified_purchase"), F.col("rating"))), 6).alias("unverified"))


@core.query("f8_extremes", f"WITH c AS (SELECT {_ITEM.format('parent_asin')} AS item, count(*) AS n FROM reviews WHERE {_ITEM.format('parent_asin')} IS NOT NULL GROUP BY 1) SELECT min(n) AS least, max(n) AS most, (SELECT CAST(min({_TS}) AS DATE) FROM reviews) AS first_day, (SELECT CAST(max({_TS}) AS DATE) FROM reviews) AS last_day FROM c")
def f8_extremes(spark, sf_dir):
    day = P.time_parts("review_ms")["day"]
    per_item = _keyed(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
    named = F.col("item").isNotNull()
    return per_item.agg(F.min(F.when(named, F.col("n"))).alias("least"), F.max(F.when(named, F.col("n"))).alias("most"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))


@core.query("c25_percent_text", "SELECT coalesce(CAST(verified_purchase AS VARCHAR), 'unknown') AS flag, count(*) || ' (' || printf('%.2f', count(*) * 100.0 / (SELECT count(*) FROM reviews)) || '%)' AS shown FROM reviews GROUP BY 1")
def c25_percent_text(spark, sf_dir):
    from opinark.functions.text import percent_text

    c = table(spark, sf_dir, "reviews").groupBy(F.coalesce(F.col("verified_purchase").cast("string"), F.lit("unknown")).alias("flag")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("flag", percent_text(F.col("n"), F.col("total")).alias("shown"))


# Windows, order, sets


@core.query("h3_most_helpful", f"SELECT item, review_id, helpful_vote FROM (SELECT {_ITEM.format('parent_asin')} AS item, review_id, helpful_vote, row_number() OVER (PARTITION BY {_ITEM.format('parent_asin')} ORDER BY helpful_vote DESC NULLS LAST, review_id, ingested_at) AS rn FROM reviews WHERE {_ITEM.format('parent_asin')} IS NOT NULL) WHERE rn <= 3")
def h3_most_helpful(spark, sf_dir):
    """The three most helpful reviews of each item: a top-k report."""
    order = Window.partitionBy("item").orderBy(F.desc_nulls_last("helpful_vote"), "review_id", "ingested_at")
    return _keyed(spark, sf_dir).where("item is not null").withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("item", "review_id", "helpful_vote")


@core.query("d10_text_equals_title", "SELECT review_id, parent_asin FROM reviews WHERE text = title OR length(text) BETWEEN 1 AND 10")
def d10_text_equals_title(spark, sf_dir):
    return table(spark, sf_dir, "reviews").where((F.col("text") == F.col("title")) | F.length("text").between(1, 10)).select("review_id", "parent_asin")


@core.query("i5_short_intersect", "SELECT text FROM reviews WHERE length(text) < 40 INTERSECT SELECT title AS text FROM reviews")
def i5_short_intersect(spark, sf_dir):
    r = table(spark, sf_dir, "reviews")
    return r.where(F.length("text") < 40).select("text").intersect(r.select(F.col("title").alias("text")))


@core.query("i6_union_distinct", "SELECT count(*) AS n FROM (SELECT sentence_text FROM seed_42 UNION SELECT sentence_text FROM ate_all)")
def i6_union_distinct(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("sentence_text") for t in ("seed_42", "ate_all"))
    return a.unionByName(b).distinct().agg(F.count("*").alias("n"))


# Samples and splits


@core.query("g6_per_category_sample", "SELECT category, row_id FROM (SELECT translate(lower(trim(category_name)), ' -', '__') AS category, row_id, row_number() OVER (PARTITION BY translate(lower(trim(category_name)), ' -', '__') ORDER BY md5(row_id || ':42'), row_id) AS rn FROM reviews_cleaning2) WHERE rn <= 8")
def g6_per_category_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", name_key("category_name").alias("category"))
    return S.per_group(rows, "category", "row_id", 8).select("category", "row_id")


@core.query("j2_exact_sample", "SELECT row_id FROM reviews_cleaning2 ORDER BY md5(row_id || ':42'), row_id LIMIT 500")
def j2_exact_sample(spark, sf_dir):
    return S.exact(table(spark, sf_dir, "reviews_cleaning2").select("row_id"), "row_id", 500).select("row_id")


@core.query("j1_bernoulli_sample")
def j1_bernoulli_sample(spark, sf_dir):
    return S.bernoulli(table(spark, sf_dir, "reviews_cleaning2"), "row_id", 0.1).select("row_id")


@core.query("j4_stratified_split", "SELECT row_id, CASE WHEN rk < round(n * 0.8) THEN 'train' WHEN rk < round(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM (SELECT row_id, row_number() OVER (PARTITION BY keep ORDER BY md5(row_id || ':42'), row_id) - 1 AS rk, count(*) OVER (PARTITION BY keep) AS n FROM reviews_cleaning2)")
def j4_stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").select("row_id", "keep")
    return S.stratified_split(rows, ["keep"], "row_id", [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).select("row_id", "split")


@core.query("j8_upsample", "SELECT row_id, CAST(c AS INTEGER) AS copy_no FROM (SELECT row_id, unnest(range(1, CASE WHEN rating = 3 THEN 4 ELSE 2 END)) AS c FROM seed_42)")
def j8_upsample(spark, sf_dir):
    return S.upsample(table(spark, sf_dir, "seed_42").select("row_id", "rating"), F.col("rating") == 3, 3).select("row_id", "copy_no")


# Star schema: the same operators on the order tables


@core.query("f4_part_revenue", "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def f4_part_revenue(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    j = lookup_join(table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_discount"), parts, ["l_partkey"])
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@core.query("f6_orders_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2")
def f6_orders_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
