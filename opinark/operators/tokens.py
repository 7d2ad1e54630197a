"""Rules over annotated tokens: what a sentence is about and whether it holds an opinion.

Tokens are array<struct<i,text,lemma,tag,pos,dep,head>>, head being the place of the governing
token. Any annotator may fill them; the rules stay expressions. annotate() is a small lexicon
annotator for where no parser is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinark import lexicons
from opinark.functions import text as X
from opinark.operators.clean import first_reason
from opinark.schemas import TOKENS

Annotator = Callable[[DataFrame], DataFrame]
_SUBJECT = ("nsubj", "nsubjpass")
_OBJECT = ("dobj", "obj")
_TARGET = (*_SUBJECT, *_OBJECT, "pobj", "attr")
_COMPLEMENT = ("acomp", "attr", "oprd", "xcomp")


def _noun(t: Column) -> Column:
    return t["pos"].isin("NOUN", "PROPN")


def _any(ts: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(ts, lambda t: F.coalesce(f(t), F.lit(False)))


def _head(ts: Column, t: Column) -> Column:
    return F.get(ts, t["head"])


def _child(ts: Column, t: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(ts, lambda c: F.coalesce((c["head"] == t["i"]) & (c["i"] != t["i"]) & f(c), F.lit(False)))


def _lemma(t: Column) -> Column:
    return F.lower(t["lemma"])


#: Relations in which a noun or pronoun heads a noun phrase.
CHUNK_HEADS = ("nsubj", "nsubjpass", "dobj", "obj", "pobj", "pcomp", "dative", "attr", "oprd", "appos", "ROOT")


def has_noun(ts: Column) -> Column:
    """There is a noun, or a pronoun that is a noun phrase by itself."""
    return _any(ts, lambda t: _noun(t) | ((t["pos"] == "PRON") & t["dep"].isin(*CHUNK_HEADS)))


def is_adjective_only(ts: Column) -> Column:
    allowed = F.forall(ts, lambda t: t["pos"].isin("ADJ", "ADV", "CCONJ", "SCONJ", "PART", "INTJ", "PUNCT"))
    return (F.size(ts) > 0) & allowed


def is_pronoun_target_only(ts: Column) -> Column:
    """A pronoun is subject or object, and no noun is."""
    pronoun = _any(ts, lambda t: t["dep"].isin(*_TARGET) & ~_noun(t) & ((t["pos"] == "PRON") | F.lower(t["text"]).isin(*lexicons.PRONOUNS)))
    return pronoun & ~_any(ts, lambda t: t["dep"].isin(*_TARGET) & _noun(t))


def all_subjects_pronouns(ts: Column, none_counts: bool = False) -> Column:
    """Every subject is a pronoun; none_counts: also where there is no subject."""
    subjects = F.filter(ts, lambda t: t["dep"].isin(*_SUBJECT))
    every = F.forall(subjects, lambda t: F.lower(t["text"]).isin(*lexicons.PRONOUNS))
    return every if none_counts else (F.size(subjects) > 0) & every


def key(t: Column) -> Column:
    return F.coalesce(F.nullif(F.nullif(F.trim(_lemma(t)), F.lit("")), F.lit("-pron-")), F.lower(F.trim(t["text"])))


def all_targets_generic(ts: Column, none_counts: bool = False) -> Column:
    """There are noun targets, and all are generic or noise by lemma; none_counts: also where there is no target."""
    nouns = F.filter(ts, lambda t: t["dep"].isin(*_TARGET, "conj") & _noun(t))
    every = F.forall(nouns, lambda t: key(t).isin(*lexicons.GENERIC_NOUNS, *lexicons.DOMAIN_NOISE))
    return every if none_counts else (F.size(nouns) > 0) & every


def _opinion_predicate(ts: Column, t: Column) -> Column:
    return (
        (t["pos"] == "ADJ")
        | ((t["pos"] == "VERB") & (_lemma(t).isin(*lexicons.OPINION_VERBS, *lexicons.LINKING_VERBS) | _child(ts, t, lambda c: c["dep"].isin(*_COMPLEMENT) & (c["pos"] == "ADJ"))))
        | ((t["pos"] == "AUX") & (_lemma(t).isin(*lexicons.LINKING_VERBS) | _child(ts, t, lambda c: c["dep"].isin(*_COMPLEMENT) & (c["pos"] == "ADJ"))))
    )


def _noun_subject(ts: Column, t: Column) -> Column:
    return _child(ts, t, lambda c: c["dep"].isin(*_SUBJECT) & _noun(c))


#: Each pattern by name, as a condition on one token and its sentence.
PATTERNS: dict[str, Callable[[Column, Column], Column]] = {
    "amod(adj,noun)": lambda ts, t: (t["dep"] == "amod") & (t["pos"] == "ADJ") & _noun(_head(ts, t)),
    "nsubj(noun,opinion_predicate)": lambda ts, t: t["dep"].isin(*_SUBJECT) & _noun(t) & _opinion_predicate(ts, _head(ts, t)),
    "obj(noun,opinion_verb)": lambda ts, t: t["dep"].isin(*_OBJECT) & _noun(t) & (_head(ts, t)["pos"] == "VERB") & _lemma(_head(ts, t)).isin(*lexicons.OPINION_VERBS),
    "copula_adj_noun_subject": lambda ts, t: (t["pos"] == "ADJ")
    & ((_child(ts, t, lambda c: c["dep"] == "cop") & _noun_subject(ts, t)) | (_head(ts, t)["pos"].isin("VERB", "AUX") & _lemma(_head(ts, t)).isin(*lexicons.LINKING_VERBS) & _noun_subject(ts, _head(ts, t)))),
    "conj(opinion1,opinion2)": lambda ts, t: (t["dep"] == "conj") & (t["pos"] == "ADJ") & (_head(ts, t)["pos"] == "ADJ"),
    "conj(aspect1,aspect2)": lambda ts, t: (t["dep"] == "conj") & _noun(t) & _noun(_head(ts, t)),
    "neg(negation,opinion_word)": lambda ts, t: (t["dep"] == "neg") & ((_head(ts, t)["pos"] == "ADJ") | _lemma(_head(ts, t)).isin(*lexicons.OPINION_VERBS, *lexicons.LINKING_VERBS)),
    "obj(noun,verb)+xcomp(adj,verb)": lambda ts, t: t["dep"].isin(*_OBJECT) & _noun(t) & (_head(ts, t)["pos"] == "VERB") & _child(ts, _head(ts, t), lambda c: (c["dep"] == "xcomp") & (c["pos"] == "ADJ")),
}


def matched_patterns(ts: Column) -> Column:
    """Names of the patterns that hold, in registry order."""
    return F.array_compact(F.array(*(F.when(_any(ts, lambda t, f=f: f(ts, t)), name) for name, f in PATTERNS.items())))


def audit(df: DataFrame, tokens: str, normalized: str) -> DataFrame:
    """The full audit of a sentence: flags, patterns, final text, first failing reason."""
    ts = F.col(tokens)
    words = X.tokens(normalized)
    flagged = df.withColumns(
        {
            "char_count": F.length(normalized),
            "token_count": F.size(words),
            "generic_token_hits": F.size(F.filter(ts, lambda t: key(t).isin(*lexicons.GENERIC_NOUNS))),
            "domain_noise_hits": F.size(F.filter(ts, lambda t: key(t).isin(*lexicons.DOMAIN_NOISE))),
            "final_text": F.array_join(F.transform(ts, lambda t: F.when(key(t).isin(*lexicons.GENERIC_NOUNS), lexicons.GENERIC_TAG).when(key(t).isin(*lexicons.DOMAIN_NOISE), lexicons.NOISE_TAG).otherwise(F.lower(t["text"]))), " "),
            "flag_too_short": (F.length(normalized) < 5) | (F.size(words) < 2),
            "flag_social": X.is_social(normalized),
            "flag_no_noun_or_np": ~has_noun(ts),
            "flag_adj_only": is_adjective_only(ts),
            "flag_pronoun_target_only": is_pronoun_target_only(ts),
            "flag_all_targets_generic_or_noise": all_targets_generic(ts),
            "matched_patterns": matched_patterns(ts),
        }
    )
    rules = [
        ("too_short", F.col("flag_too_short")),
        ("social", F.col("flag_social")),
        ("no_noun_or_noun_phrase", F.col("flag_no_noun_or_np")),
        ("adjective_only_phrase", F.col("flag_adj_only")),
        ("pronoun_target_only", F.col("flag_pronoun_target_only")),
        ("all_targets_generic_or_noise", F.col("flag_all_targets_generic_or_noise")),
        ("no_dependency_pattern", F.size("matched_patterns") == 0),
    ]
    return flagged.withColumn("primary_reason", first_reason(rules)).withColumn("keep", F.col("primary_reason") == "kept")


def annotate(df: DataFrame, text: str, nouns: tuple[str, ...] = (), adjectives: tuple[str, ...] = (), into: str = "tokens") -> DataFrame:
    """Tokens by word lists: nouns (and generic and noise nouns), adjectives, linking and opinion verbs, pronouns.

    An adjective before a noun is its modifier; a noun before a linking verb its subject; an
    adjective after a linking verb depends on it; 'not' negates the word before it.
    """
    words = X.tokens(text)
    all_nouns = (*nouns, *lexicons.GENERIC_NOUNS, *lexicons.DOMAIN_NOISE)
    linking = ("is", "was", "are", "were", "be", *lexicons.LINKING_VERBS[1:])

    def lemma(w: Column) -> Column:
        return F.when(w.isin("is", "was", "are", "were"), "be").otherwise(F.regexp_replace(w, r"(?<=[a-z]{3})(ed|s)$", ""))

    def pos(w: Column) -> Column:
        return (
            F.when(w.isin(*all_nouns), "NOUN").when(w.isin(*adjectives), "ADJ").when(w.isin("is", "was", "are", "were", "be"), "AUX")
            .when(w.isin(*linking) | lemma(w).isin(*lexicons.OPINION_VERBS, *lexicons.LINKING_VERBS), "VERB").when(w.isin(*lexicons.PRONOUNS), "PRON").when(w == "not", "PART").otherwise("X")
        )

    tagged = F.transform(words, lambda w, i: F.struct(i.cast("int").alias("i"), w.alias("text"), lemma(w).alias("lemma"), pos(w).alias("pos")))

    def relate(t: Column, ts: Column) -> Column:
        before, after = F.get(ts, t["i"] - 1), F.get(ts, t["i"] + 1)
        verb_after = F.coalesce(after["pos"].isin("AUX", "VERB"), F.lit(False))
        verb_before = F.coalesce(before["pos"].isin("AUX", "VERB"), F.lit(False))
        noun_after = F.coalesce(after["pos"] == "NOUN", F.lit(False))
        dep = (
            F.when((t["pos"] == "ADJ") & noun_after, "amod").when((t["pos"].isin("NOUN", "PRON")) & verb_after, "nsubj").when((t["pos"] == "ADJ") & verb_before, "acomp")
            .when((t["pos"] == "NOUN") & verb_before, "obj").when(t["text"] == "not", "neg").otherwise("dep")
        )
        head = F.when(dep.isin("amod", "nsubj"), t["i"] + 1).when(dep.isin("acomp", "obj", "neg"), F.greatest(t["i"] - 1, F.lit(0))).otherwise(t["i"])
        return F.struct(t["i"].alias("i"), t["text"].alias("text"), t["lemma"].alias("lemma"), t["pos"].alias("tag"), t["pos"].alias("pos"), dep.alias("dep"), head.cast("int").alias("head"))

    with_tags = df.withColumn("_t", tagged)
    return with_tags.withColumn(into, F.transform("_t", lambda t: relate(t, F.col("_t"))).cast(TOKENS)).drop("_t")
