"""Queries of the text functions and of the cleaning stages."""

from pyspark.sql import functions as F

from opinark import lexicons
from opinark.functions import text as X
from opinark.operators import clean
from opinark.plans.registry import core
from opinark.runtime import name_key, table

# SQL pieces of the oracle, written from the definitions of the functions.


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join(map(_s, words)) + "]"


def _substrings(x: str) -> str:
    for k, v in sorted(lexicons.SUBSTRING_CONTRACTIONS.items(), key=lambda kv: -len(kv[0])):
        x = f"replace({x}, {_s(k)}, {_s(v)})"
    return x


_MERGE = """CASE WHEN coalesce(trim(title), '') <> '' AND coalesce(trim(text), '') <> '' THEN trim(title) || '. ' || trim(text)
 WHEN coalesce(trim(title), '') <> '' THEN trim(title) ELSE coalesce(trim(text), '') END"""
_LOWER = _collapse("regexp_replace(lower({0}), '[^a-z0-9\\s.!?]', ' ', 'g')")
_KEEP = _collapse("regexp_replace({0}, '[^a-zA-Z0-9.?!\\s]', '', 'g')")
_UNI = "regexp_replace(" + _collapse("lower({0})") + ", '[^\\p{{L}}\\p{{N}}_\\s.!?]', '', 'g')"
_CONCAT = "concat_ws(' ', title, text)"
_CONTRACTION_MAP = "MAP {" + ", ".join(f"{_s(k)}: {_s(v)}" for k, v in lexicons.WORD_CONTRACTIONS.items()) + "}"


def _expand_words(x: str) -> str:
    """x must be in lower case."""
    w = "ltrim(w, '''')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[a-z0-9_'']*[a-z0-9_]|[^a-z0-9_]'), lambda w: "
        f"coalesce(substr(w, 1, length(w) - length({w})) || ({_CONTRACTION_MAP})[{w}], w)), '')"
    )


_NORM_IN = "trim(lower(replace(replace(replace(coalesce(sentence_text, ''), '’', ''''), '`', ''''), '´', '''')))"
_NORM = f"CASE WHEN {_NORM_IN} = 'nan' THEN '' ELSE " + _collapse(f"regexp_replace({_expand_words(_NORM_IN)}, '[^a-z0-9\\s'']', ' ', 'g')") + " END"


def _tag(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({_collapse(x)}, ' '), lambda w: CASE WHEN list_contains({_list(lexicons.GENERIC_NOUNS)}, trim(w, '''')) THEN '[GENERIC_NOUN]' "
        f"WHEN list_contains({_list(lexicons.DOMAIN_NOISE)}, trim(w, '''')) THEN '[DOMAIN_NOISE]' ELSE w END), ' ')"
    )


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "reviews")


def _text_query(name, column, sql):
    """A query of one text function over reviews: (review_id, parent_asin, value). column is called when the query runs."""
    core.query(name, f"SELECT review_id, parent_asin, {sql} AS value FROM reviews")(lambda spark, d: _reviews(spark, d).select("review_id", "parent_asin", column().alias("value")))


_text_query("c1_concat_text", lambda: X.concat_text("title", "text"), _CONCAT)
_text_query("c2_merge_text", lambda: X.merge_text("title", "text"), _MERGE)
_text_query("c5a_whitelist_lower", lambda: X.whitelist_lower("text"), _LOWER.format("text"))
_text_query("c5b_whitelist_keep_case", lambda: X.whitelist_keep_case("text"), _KEEP.format("text"))
_text_query("c5c_whitelist_unicode", lambda: X.whitelist_unicode("text"), _UNI.format("text"))
_text_query("c7_drop_br", lambda: X.drop_br("text"), _collapse("regexp_replace(text, '\\bbr\\b', ' ', 'g')"))
_text_query("c8_expand_substrings", lambda: X.expand_substrings("text"), _substrings("lower(text)"))
_text_query("c9_expand_words", lambda: X.expand_words("text"), _expand_words("lower(text)"))
_text_query("c17_clean_text", lambda: X.clean_text("text"), _collapse("coalesce(text, '')"))
_text_query("c18_clean_gold", lambda: X.clean_gold("text"), _collapse("regexp_replace(regexp_replace(replace(text, '[GENERIC_NOUN]', ' '), '(?i)<br\\s*/?>', ' ', 'g'), '\\bbr\\b', ' ', 'g')"))
_text_query("c19_normalize_span", lambda: X.normalize_span("title"), "trim(" + _collapse("title") + ", ' ' || chr(9) || chr(10) || chr(13) || '.,;:!?()[]{}\"''`')")
_text_query("c20a_normalize_aspect_ascii", lambda: X.normalize_aspect("title", "ascii"), _collapse("regexp_replace(title, '[^a-z0-9\\s]+', ' ', 'g')"))
_text_query("c20b_normalize_aspect_unicode", lambda: X.normalize_aspect("title", "unicode"), _collapse("regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]+', ' ', 'g')"))
_text_query("c20c_normalize_aspect_gold", lambda: X.normalize_aspect("title", "gold"), _collapse("regexp_replace(" + _collapse("regexp_replace(regexp_replace(replace(lower(title), '[GENERIC_NOUN]', ' '), '(?i)<br\\s*/?>', ' ', 'g'), '\\bbr\\b', ' ', 'g')") + ", '[^a-z0-9\\s]+', ' ', 'g')"))
_text_query("c50_fill_blank", lambda: X.fill_blank("title", "untitled"), "coalesce(nullif(trim(title), ''), 'untitled')")


@core.query("c6_strip_html", "SELECT doc_id, " + _collapse("regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[^a-zA-Z0-9_\\s.,!?;:()/-]', '', 'g')") + " AS value FROM documents")
def c6_strip_html(spark, sf_dir):
    """The part of the HTML cleaning that SQL can say: tags out, ASCII whitelist."""
    text = X.collapse(F.regexp_replace(X.strip_tags("text"), r"[^a-zA-Z0-9_\s.,!?;:()/-]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("value"))


@core.query("c6_clean_html")
def c6_clean_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_html("text").alias("value"))


@core.query("c10_normalize_sentence", f"SELECT row_id, {_NORM} AS value FROM reviews_cleaning2")
def c10_normalize_sentence(spark, sf_dir):
    return table(spark, sf_dir, "reviews_cleaning2").select("row_id", X.normalize_sentence("sentence_text").alias("value"))


_COUNTS = "CAST((length({0}) - length(replace({0}, {1}, ''))) / length({1}) AS INTEGER)"


@core.query(
    "c11_tag_lexicon",
    f"WITH t AS (SELECT row_id, {_tag(_NORM)} AS tagged FROM reviews_cleaning2) SELECT row_id, tagged, {_COUNTS.format('tagged', _s('[GENERIC_NOUN]'))} AS generic_hits, {_COUNTS.format('tagged', _s('[DOMAIN_NOISE]'))} AS noise_hits FROM t",
)
def c11_tag_lexicon(spark, sf_dir):
    tagged = clean.tag_sentences(table(spark, sf_dir, "reviews_cleaning2").select("row_id", "sentence_text"), "sentence_text")
    return tagged.select("row_id", "tagged", "generic_hits", "noise_hits")


@core.query("c13_tag_totals", f"WITH t AS (SELECT {_tag(_NORM)} AS tagged FROM reviews_cleaning2) SELECT CAST(sum({_COUNTS.format('tagged', _s('[GENERIC_NOUN]'))}) AS BIGINT) AS generic_tags, CAST(sum({_COUNTS.format('tagged', _s('[DOMAIN_NOISE]'))}) AS BIGINT) AS noise_tags FROM t")
def c13_tag_totals(spark, sf_dir):
    tagged = clean.tag_sentences(table(spark, sf_dir, "reviews_cleaning2").select("sentence_text"), "sentence_text")
    return tagged.agg(F.sum("generic_hits").alias("generic_tags"), F.sum("noise_hits").alias("noise_tags"))


@core.query(
    "c14_token_counts",
    "SELECT row_id, CAST(len(regexp_extract_all(lower(sentence_text), '[a-z0-9'']+')) AS INTEGER) AS n_tokens, CAST(len(regexp_extract_all(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?')) AS INTEGER) AS n_unicode_tokens, "
    "CAST(len(string_split_regex(sentence_text, '\\s+')) AS INTEGER) AS n_words, CAST(length(sentence_text) AS INTEGER) AS n_chars FROM reviews_cleaning2",
)
def c14_token_counts(spark, sf_dir):
    t = F.col("sentence_text")
    return table(spark, sf_dir, "reviews_cleaning2").select("row_id", F.size(X.tokens(F.lower(t))).alias("n_tokens"), F.size(X.unicode_tokens(t)).alias("n_unicode_tokens"), X.word_count(t).alias("n_words"), F.length(t).alias("n_chars"))


@core.query("c22_review_id_number", "SELECT row_id, TRY_CAST(trim(review_id) AS BIGINT) AS review_no FROM reviews_cleaning2 WHERE regexp_matches(trim(review_id), '^[0-9]+$') OR review_id IS NULL")
def c22_review_id_number(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews_cleaning2").where(F.regexp_like(F.trim("review_id"), F.lit("^[0-9]+$")) | F.col("review_id").isNull())
    return rows.select("row_id", F.trim("review_id").try_cast("bigint").alias("review_no"))


@core.query("c43_delete_words")
def c43_delete_words(spark, sf_dir):
    return table(spark, sf_dir, "seed_42").select("row_id", X.delete_words("sentence_text", F.col("row_id")).alias("value"))


# Stage 1


def _stage1_sql(merge: str, norm: str, keys: str) -> str:
    return f"""WITH m AS (SELECT *, {merge} AS review_text FROM reviews),
    d AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ingested_at, review_ms, review_id, asin, helpful_vote, coalesce(user_id, '')) AS rn FROM m WHERE review_text IS NOT NULL AND trim(review_text) <> ''),
    n AS (SELECT review_id, {norm.format('review_text')} AS review_text FROM d WHERE rn = 1)
    SELECT review_id, review_text FROM n WHERE trim(review_text, ' ') <> ''"""


def _stage1(variant):
    def run(spark, sf_dir):
        kept = clean.merge_dedup_normalize(_reviews(spark, sf_dir), variant, ["ingested_at", "review_ms", "review_id", "asin", "helpful_vote", F.coalesce("user_id", F.lit(""))])
        return kept.select("review_id", "review_text")

    return run


core.query("i1_stage1_electronics", _stage1_sql(_CONCAT, _LOWER, "review_text"))(_stage1("electronics"))
core.query("i2_stage1_software", _stage1_sql(_CONCAT, _UNI, "parent_asin, review_text"))(_stage1("software"))
core.query("i3_stage1_office", _stage1_sql(_CONCAT, _KEEP, "review_text, user_id, parent_asin"))(_stage1("office"))
core.query("i2_stage1_kindle")(_stage1("kindle"))

_SENTENCES = """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s.!?]', ' ', 'g'), '\\s+', ' ', 'g')), '[.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(parts) AS sentence_text, unnest(range(1, len(parts) + 1)) AS sentence_id FROM s)"""


def _sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.whitelist_lower("text").alias("text"))
    return clean.split_marks(docs, "text").select("doc_id", F.col("sentence_id").cast("bigint").alias("sentence_id"), "sentence_text")


@core.query("j0a_split_sentences", _SENTENCES + " SELECT doc_id, sentence_id, sentence_text FROM x")
def j0a_split_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


@core.query(
    "j0b_split_lookbehind",
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS sentence_id, unnest(parts) AS sentence_text FROM s""",
)
def j0b_split_lookbehind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return clean.split_lookbehind(docs, "text").select("doc_id", "sentence_id", "sentence_text")


# Stage 2


@core.query("g1_renumber_kept", _SENTENCES + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) AS new_id, sentence_text FROM x WHERE NOT (length(sentence_text) < 5 OR len(string_split_regex(sentence_text, '\\s+')) < 2)")
def g1_renumber_kept(spark, sf_dir):
    kept = _sentences(spark, sf_dir).where(~X.is_too_short("sentence_text"))
    return clean.renumber(kept, "doc_id", ["sentence_id"], "new_id").select("doc_id", F.col("new_id").cast("bigint").alias("new_id"), "sentence_text")


@core.query("g3_renumber_alphabetical", _SENTENCES + " SELECT doc_id, sentence_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_text, sentence_id) AS new_id FROM x")
def g3_renumber_alphabetical(spark, sf_dir):
    return clean.renumber(_sentences(spark, sf_dir), "doc_id", ["sentence_text", "sentence_id"], "new_id").select("doc_id", "sentence_id", F.col("new_id").cast("bigint").alias("new_id"))


_SOCIAL = "regexp_matches({0}, '^(" + "|".join(f"({p})" for p in lexicons.SOCIAL_PATTERNS) + ")$')"
_AUDIT = f"""WITH n AS (SELECT row_id, category_name, {_NORM} AS norm FROM reviews_cleaning2),
t AS (SELECT *, {_tag('norm')} AS tagged FROM n),
a AS (SELECT *, CASE WHEN norm = '' THEN 'blank' WHEN length(norm) < 5 OR len(regexp_extract_all(norm, '[a-z0-9'']+')) < 2 THEN 'too_short' WHEN {_SOCIAL.format('norm')} THEN 'social'
 WHEN len(list_filter(string_split(tagged, ' '), lambda w: w NOT IN ('[GENERIC_NOUN]', '[DOMAIN_NOISE]'))) = 0 THEN 'all_targets_generic_or_noise' ELSE 'kept' END AS reason FROM t)"""


def _audit(spark, sf_dir):
    return clean.short_text_audit(table(spark, sf_dir, "reviews_cleaning2").select("row_id", "category_name", "sentence_text"), "sentence_text")


@core.query("d4_reason_cascade", _AUDIT + " SELECT row_id, reason FROM a")
def d4_reason_cascade(spark, sf_dir):
    return _audit(spark, sf_dir).select("row_id", "reason")


@core.query("d2_short_counts", f"WITH n AS (SELECT {_NORM} AS norm FROM reviews_cleaning2) SELECT count(*) FILTER (WHERE length(norm) < 5 OR len(string_split_regex(norm, '\\s+')) < 2) AS n_short, count(*) FILTER (WHERE NOT (length(norm) < 5 OR len(string_split_regex(norm, '\\s+')) < 2)) AS n_valid FROM n")
def d2_short_counts(spark, sf_dir):
    n = table(spark, sf_dir, "reviews_cleaning2").select(X.normalize_sentence("sentence_text").alias("n"))
    short = X.is_too_short("n")
    return n.agg(F.count_if(short).alias("n_short"), F.count_if(~short).alias("n_valid"))


@core.query("d5_social", f"WITH n AS (SELECT row_id, {_NORM} AS norm FROM reviews_cleaning2) SELECT row_id, norm FROM n WHERE {_SOCIAL.format('norm')}")
def d5_social(spark, sf_dir):
    return table(spark, sf_dir, "reviews_cleaning2").select("row_id", X.normalize_sentence("sentence_text").alias("norm")).where(X.is_social("norm"))


@core.query(
    "f20_stage2_report",
    _AUDIT.replace("row_id, category_name,", "row_id, translate(lower(trim(category_name)), ' -', '__') AS category,")
    + " SELECT category, count(*) AS n_in, count(*) FILTER (WHERE reason = 'kept') AS n_kept, count(*) FILTER (WHERE reason = 'too_short') AS n_short, count(*) FILTER (WHERE reason = 'social') AS n_social, round(count(*) FILTER (WHERE reason = 'kept') / count(*), 6) AS kept_share FROM a GROUP BY category",
)
def f20_stage2_report(spark, sf_dir):
    """Totals of the audit by category in one pass: the flagship of the cleaning stages."""
    audited = _audit(spark, sf_dir).withColumn("category", name_key("category_name"))
    reason = F.col("reason")
    return audited.groupBy("category").agg(
        F.count("*").alias("n_in"), F.count_if(reason == "kept").alias("n_kept"), F.count_if(reason == "too_short").alias("n_short"), F.count_if(reason == "social").alias("n_social"),
        F.round(F.count_if(reason == "kept") / F.count("*"), 6).alias("kept_share"),
    )


@core.query("f21_reason_counts", "SELECT primary_reason AS reason, count(*) AS n, count(DISTINCT parent_asin) AS n_items FROM reviews_cleaning2 GROUP BY 1")
def f21_reason_counts(spark, sf_dir):
    return table(spark, sf_dir, "reviews_cleaning2").groupBy(F.col("primary_reason").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("parent_asin").alias("n_items"))
