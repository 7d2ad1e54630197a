"""Queries of the rules over annotated tokens, on tokens whose annotation comes from a hash so that every shape occurs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinark import lexicons
from opinark.functions import text as X
from opinark.operators import tokens
from opinark.plans.registry import core
from opinark.runtime import table

_POS = {"01234": "NOUN", "56": "ADJ", "789": "VERB", "ab": "AUX", "c": "PRON", "d": "ADV", "e": "PROPN", "f": "PART"}
_DEP = {"01": "nsubj", "2": "amod", "3": "obj", "4": "conj", "5": "neg", "6": "xcomp", "7": "acomp", "8": "cop", "9": "pobj", "a": "nsubjpass", "b": "dobj", "c": "attr", "def": "dep"}
_LEMMA = {"012": "love", "345": "be", "6": "thing", "7": "shipping"}


def _by_digit(digit: Column, names: dict, other: Column | None = None) -> Column:
    out = other if other is not None else F.lit(None).cast("string")
    for digits, name in names.items():
        out = F.when(digit.isin(*digits), name).otherwise(out)
    return out


def _sql_by_digit(k: int, names: dict, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains('{d}', h[{k}]) THEN '{n}'" for d, n in names.items()) + f" ELSE {other} END"


def _annotated(spark, sf_dir):
    """Tokens of seed_42's sentences; part of speech, relation, lemma and head follow from the digits of a hash."""
    rows = table(spark, sf_dir, "seed_42").where("sentence_text is not null").select("row_id", F.lower("sentence_text").alias("norm"))
    words = rows.withColumn("ws", X.tokens("norm"))

    def token(w: Column, i: Column) -> Column:
        h = F.md5(F.concat(w, F.lit(":"), i.cast("string")))
        digit = lambda k: F.substring(h, k, 1)
        step = F.conv(digit(3), 16, 10).cast("int") % 5 - 2
        head = F.greatest(F.least(i + step, F.size("ws") - 1), F.lit(0))
        pos = _by_digit(digit(1), _POS)
        return F.struct(i.cast("int").alias("i"), w.alias("text"), _by_digit(digit(4), _LEMMA, w).alias("lemma"), pos.alias("tag"), pos.alias("pos"), _by_digit(digit(2), _DEP).alias("dep"), head.cast("int").alias("head"))

    return words.select("row_id", "norm", F.transform("ws", token).alias("tokens"))


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_SUBJ, _OBJ = "('nsubj', 'nsubjpass')", "('dobj', 'obj')"
_TARGET = "('nsubj', 'nsubjpass', 'dobj', 'obj', 'pobj', 'attr')"
_COMP = "('acomp', 'attr', 'oprd', 'xcomp')"
_NOUN = "pos IN ('NOUN', 'PROPN')"
_GENERIC, _NOISE = _in(lexicons.GENERIC_NOUNS), _in(lexicons.DOMAIN_NOISE)
_LINK, _OPINION, _PRONOUNS = _in(lexicons.LINKING_VERBS), _in(lexicons.OPINION_VERBS), _in(lexicons.PRONOUNS)
_TOKENS = f"""
w AS (SELECT row_id, lower(sentence_text) AS norm, regexp_extract_all(lower(sentence_text), '[a-z0-9'']+') AS ws FROM seed_42 WHERE sentence_text IS NOT NULL),
u AS (SELECT row_id, len(ws) AS n, unnest(ws) AS text, unnest(range(0, len(ws))) AS i FROM w),
hashed AS (SELECT *, md5(text || ':' || i) AS h FROM u),
t AS (SELECT row_id, i, text, {_sql_by_digit(1, _POS)} AS pos, {_sql_by_digit(2, _DEP)} AS dep, {_sql_by_digit(4, _LEMMA, 'text')} AS lemma,
  greatest(least(i + (strpos('0123456789abcdef', h[3]) - 1) % 5 - 2, n - 1), 0) AS head FROM hashed),
c AS (SELECT row_id, head AS i, bool_or(dep IN {_SUBJ} AND {_NOUN}) AS noun_subject, bool_or(dep = 'cop') AS cop, bool_or(dep IN {_COMP} AND pos = 'ADJ') AS adj_complement, bool_or(dep = 'xcomp' AND pos = 'ADJ') AS adj_xcomp
  FROM t WHERE head <> i GROUP BY 1, 2),
j AS (SELECT t.*, h.pos AS hpos, h.lemma AS hlemma, coalesce(o.noun_subject, false) AS own_subject, coalesce(o.cop, false) AS own_cop, coalesce(g.noun_subject, false) AS head_subject,
  coalesce(g.adj_complement, false) AS head_complement, coalesce(g.adj_xcomp, false) AS head_xcomp
  FROM t JOIN t h ON t.row_id = h.row_id AND t.head = h.i LEFT JOIN c o ON o.row_id = t.row_id AND o.i = t.i LEFT JOIN c g ON g.row_id = t.row_id AND g.i = t.head)"""
_PREDICATE = f"(hpos = 'ADJ' OR (hpos = 'VERB' AND (hlemma IN {_OPINION} OR hlemma IN {_LINK} OR head_complement)) OR (hpos = 'AUX' AND (hlemma IN {_LINK} OR head_complement)))"
_PATTERN_SQL = {
    "amod(adj,noun)": "dep = 'amod' AND pos = 'ADJ' AND hpos IN ('NOUN', 'PROPN')",
    "nsubj(noun,opinion_predicate)": f"dep IN {_SUBJ} AND {_NOUN} AND {_PREDICATE}",
    "obj(noun,opinion_verb)": f"dep IN {_OBJ} AND {_NOUN} AND hpos = 'VERB' AND hlemma IN {_OPINION}",
    "copula_adj_noun_subject": f"pos = 'ADJ' AND ((own_cop AND own_subject) OR (hpos IN ('VERB', 'AUX') AND hlemma IN {_LINK} AND head_subject))",
    "conj(opinion1,opinion2)": "dep = 'conj' AND pos = 'ADJ' AND hpos = 'ADJ'",
    "conj(aspect1,aspect2)": f"dep = 'conj' AND {_NOUN} AND hpos IN ('NOUN', 'PROPN')",
    "neg(negation,opinion_word)": f"dep = 'neg' AND (hpos = 'ADJ' OR hlemma IN {_OPINION} OR hlemma IN {_LINK})",
    "obj(noun,verb)+xcomp(adj,verb)": f"dep IN {_OBJ} AND {_NOUN} AND hpos = 'VERB' AND head_xcomp",
}
_HELD = " UNION ALL ".join(f"SELECT DISTINCT row_id, {k} AS k, '{name}' AS pattern FROM j WHERE {sql}" for k, (name, sql) in enumerate(_PATTERN_SQL.items()))


@core.query("k9_rule_patterns", f"WITH {_TOKENS}, held AS ({_HELD}) SELECT row_id, pattern FROM held")
def k9_rule_patterns(spark, sf_dir):
    """Every pattern that holds in a sentence (P1 to P9)."""
    return _annotated(spark, sf_dir).select("row_id", F.explode(tokens.matched_patterns(F.col("tokens"))).alias("pattern"))


@core.query("f22_hashed_pattern_counts", f"WITH {_TOKENS}, held AS ({_HELD}) SELECT pattern, count(*) AS n FROM held GROUP BY 1")
def f22_hashed_pattern_counts(spark, sf_dir):
    return k9_rule_patterns(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("n"))


_CHUNK_HEADS = _in(tokens.CHUNK_HEADS)
_FLAGS = f"""
f AS (SELECT w.row_id, norm, len(ws) AS n_words,
  coalesce(bool_or({_NOUN} OR (pos = 'PRON' AND dep IN {_CHUNK_HEADS})), false) AS has_noun,
  coalesce(bool_and(pos IN ('ADJ', 'ADV', 'CCONJ', 'SCONJ', 'PART', 'INTJ', 'PUNCT')), false) AS adj_only,
  coalesce(bool_or(dep IN {_TARGET} AND NOT ({_NOUN}) AND (pos = 'PRON' OR text IN {_PRONOUNS})), false) AND NOT coalesce(bool_or(dep IN {_TARGET} AND {_NOUN}), false) AS pronoun_only,
  coalesce(bool_and(text IN {_PRONOUNS}) FILTER (WHERE dep IN {_SUBJ}), false) AS subjects_pronouns,
  coalesce(bool_and(text IN {_PRONOUNS}) FILTER (WHERE dep IN {_SUBJ}), true) AS subjects_pronouns_or_none,
  coalesce(bool_and(lemma IN {_GENERIC} OR lemma IN {_NOISE}) FILTER (WHERE (dep IN {_TARGET} OR dep = 'conj') AND {_NOUN}), false) AS generic,
  coalesce(bool_and(lemma IN {_GENERIC} OR lemma IN {_NOISE}) FILTER (WHERE (dep IN {_TARGET} OR dep = 'conj') AND {_NOUN}), true) AS generic_or_none,
  CAST(count(*) FILTER (WHERE lemma IN {_GENERIC}) AS INTEGER) AS generic_hits, CAST(count(*) FILTER (WHERE lemma IN {_NOISE}) AS INTEGER) AS noise_hits,
  coalesce(string_agg(CASE WHEN lemma IN {_GENERIC} THEN '[GENERIC_NOUN]' WHEN lemma IN {_NOISE} THEN '[DOMAIN_NOISE]' ELSE text END, ' ' ORDER BY i), '') AS final_text
  FROM w LEFT JOIN t ON t.row_id = w.row_id GROUP BY 1, 2, 3)"""


@core.query("k3_target_rules", f"WITH {_TOKENS}, {_FLAGS} SELECT row_id, has_noun, adj_only, pronoun_only, subjects_pronouns, subjects_pronouns_or_none, generic, generic_or_none FROM f")
def k3_target_rules(spark, sf_dir):
    """The rules on what a sentence is about (K3 to K6, with the variants that differ where there is no target)."""
    ts = F.col("tokens")
    return _annotated(spark, sf_dir).select(
        "row_id", tokens.has_noun(ts).alias("has_noun"), tokens.is_adjective_only(ts).alias("adj_only"), tokens.is_pronoun_target_only(ts).alias("pronoun_only"),
        tokens.all_subjects_pronouns(ts).alias("subjects_pronouns"), tokens.all_subjects_pronouns(ts, none_counts=True).alias("subjects_pronouns_or_none"),
        tokens.all_targets_generic(ts).alias("generic"), tokens.all_targets_generic(ts, none_counts=True).alias("generic_or_none"),
    )


_SOCIAL = "regexp_matches(norm, '^(" + "|".join(f"({p})" for p in lexicons.SOCIAL_PATTERNS) + ")$')"


@core.query(
    "k8_full_audit",
    f"""WITH {_TOKENS}, {_FLAGS}, held AS ({_HELD}), p AS (SELECT row_id, string_agg(pattern, '|' ORDER BY k) AS patterns FROM held GROUP BY 1),
    a AS (SELECT f.*, coalesce(patterns, '') AS patterns, CASE WHEN length(norm) < 5 OR n_words < 2 THEN 'too_short' WHEN {_SOCIAL} THEN 'social' WHEN NOT has_noun THEN 'no_noun_or_noun_phrase' WHEN adj_only THEN 'adjective_only_phrase'
      WHEN pronoun_only THEN 'pronoun_target_only' WHEN generic THEN 'all_targets_generic_or_noise' WHEN patterns IS NULL THEN 'no_dependency_pattern' ELSE 'kept' END AS primary_reason FROM f LEFT JOIN p USING (row_id))
    SELECT row_id, primary_reason, primary_reason = 'kept' AS keep, patterns, generic_hits, noise_hits, final_text FROM a""",
)
def k8_full_audit(spark, sf_dir):
    """The whole audit row of every sentence (K7, K8, C12)."""
    audited = tokens.audit(_annotated(spark, sf_dir), "tokens", "norm")
    return audited.select("row_id", "primary_reason", "keep", F.array_join("matched_patterns", "|").alias("patterns"), F.col("generic_token_hits").alias("generic_hits"), F.col("domain_noise_hits").alias("noise_hits"), "final_text")


@core.query(
    "c15_token_offsets",
    """WITH w AS (SELECT row_id, regexp_extract_all(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?') AS ws, string_split_regex(sentence_text, '[\\p{L}\\p{N}_]+(?:''[\\p{L}\\p{N}_]+)?') AS gaps FROM seed_42 WHERE sentence_text IS NOT NULL),
    u AS (SELECT row_id, ws, gaps, unnest(range(1, len(ws) + 1)) AS k FROM w),
    p AS (SELECT row_id, k, ws[k] AS token, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM u)
    SELECT row_id, CAST(k AS INTEGER) AS place, token, start, CAST(start + length(token) AS INTEGER) AS stop FROM p""",
)
def c15_token_offsets(spark, sf_dir):
    """Words of any script with the characters they stand at."""
    rows = table(spark, sf_dir, "seed_42").where("sentence_text is not null")
    found = rows.select("row_id", F.posexplode(X.token_offsets("sentence_text")).alias("p", "t"))
    return found.select("row_id", (F.col("p") + 1).alias("place"), F.col("t.token").alias("token"), F.col("t.start").alias("start"), F.col("t.stop").alias("stop"))


@core.query("c42_fill_tags", "SELECT row_id, replace(replace(s, '[GENERIC_NOUN]', 'thing'), '[DOMAIN_NOISE]', 'shipping') AS parsed, trim(regexp_replace(replace(replace(s, '[GENERIC_NOUN]', ''), '[DOMAIN_NOISE]', ''), '\\s+', ' ', 'g'), ' ') AS prompt FROM (SELECT row_id, replace(sentence_text, 'the', CASE WHEN row_id % 2 = 0 THEN '[GENERIC_NOUN]' ELSE '[DOMAIN_NOISE]' END) AS s FROM seed_42)")
def c42_fill_tags(spark, sf_dir):
    """Tags by words that a parser knows, and by nothing for prompts."""
    tag = F.when(F.col("row_id") % 2 == 0, lexicons.GENERIC_TAG).otherwise(lexicons.NOISE_TAG)
    rows = table(spark, sf_dir, "seed_42").select("row_id", F.replace("sentence_text", F.lit("the"), tag).alias("s"))
    return rows.select("row_id", X.fill_tags("s").alias("parsed"), X.collapse(X.fill_tags("s", "", "")).alias("prompt"))
