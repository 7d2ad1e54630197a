"""Text functions: Column to Column, all inside code generation but for NFKC.

Character classes are written out (\\p{L}, \\p{N}, _) where Unicode letters count, as \\w means
different things to different engines. Null texts stay null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark import lexicons

WORD = r"[\p{L}\p{N}_]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def concat_text(title: Column | str, text: Column | str) -> Column:
    """Title and text with a space between; nulls are skipped."""
    return F.concat_ws(" ", _c(title), _c(text))


def merge_text(title: Column | str, text: Column | str) -> Column:
    """'title. text', or the one that is not blank, or ''."""
    t, x = (F.coalesce(F.trim(_c(c)), F.lit("")) for c in (title, text))
    return F.when((t != "") & (x != ""), F.concat(t, F.lit(". "), x)).when(t != "", t).otherwise(x)


def whitelist_lower(c: Column | str) -> Column:
    """Lower case; other than letters, digits, . ! ? become spaces."""
    return collapse(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9\s.!?]", " "))


def whitelist_keep_case(c: Column | str) -> Column:
    """Case kept; other than letters, digits, . ? ! vanish."""
    return collapse(F.regexp_replace(_c(c), r"[^a-zA-Z0-9.?!\s]", ""))


def whitelist_unicode(c: Column | str) -> Column:
    """Lower case, white space collapsed, then all but letters and digits of any script, _ . ! ? vanish."""
    return F.regexp_replace(collapse(F.lower(_c(c))), r"[^\p{L}\p{N}_\s.!?]", "")


def strip_tags(c: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(_c(c), r"<[^>]+>", by)


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility normal form; the one step that Catalyst has no expression for."""

    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(normalize, T.StringType())(_c(c))


def clean_html(c: Column | str, normalize: bool = True) -> Column:
    """Tags to spaces, NFKC (rows of ASCII skip it), a whitelist of letters, digits and common marks."""
    text = strip_tags(c)
    if normalize:
        text = F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), nfkc(text)).otherwise(text)
    return collapse(F.regexp_replace(text, r"""[^\p{L}\p{N}_\s.,!?;:'"()\-/]""", ""))


def drop_br(c: Column | str) -> Column:
    """The word br, left over from line-break tags, out; white space collapsed."""
    return collapse(F.regexp_replace(_c(c), r"\bbr\b", " "))


def _replace_all(c: Column, pairs: Mapping[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), sorted(pairs.items(), key=lambda kv: -len(kv[0])), c)


def expand_substrings(c: Column | str) -> Column:
    """Contractions expanded wherever they stand, longest first; texts without apostrophe skip all that."""
    x = F.lower(_c(c))
    return F.when(F.contains(x, F.lit("'")), _replace_all(x, lexicons.SUBSTRING_CONTRACTIONS)).otherwise(x)


def expand_words(c: Column | str) -> Column:
    """Contractions expanded as whole words, by one lookup per token."""
    return _expand(F.lower(_c(c)))


def _expand(x: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in lexicons.WORD_CONTRACTIONS.items() for v in kv))

    def expand(w: Column) -> Column:
        bare = F.ltrim(w, F.lit("'"))
        full = F.coalesce(F.concat(F.substring(w, F.lit(1), F.length(w) - F.length(bare)), F.element_at(table, bare)), w)
        return F.when(F.contains(w, F.lit("'")), full).otherwise(w)

    def expand_part(p: Column) -> Column:
        # words and the marks between them, in order
        pieces = F.regexp_extract_all(p, F.lit(r"[a-z0-9_']*[a-z0-9_]|[^a-z0-9_]"), F.lit(0))
        return F.when(F.contains(p, F.lit("'")), F.array_join(F.transform(pieces, expand), "")).otherwise(p)

    # only the few parts with an apostrophe are taken to pieces
    expanded = F.array_join(F.transform(F.split(x, " "), expand_part), " ")
    return F.when(F.contains(x, F.lit("'")), expanded).otherwise(x)


def normalize_sentence(c: Column | str) -> Column:
    """Lower case, straight apostrophes, contractions as words, a-z 0-9 ' only; null and 'nan' give ''."""
    x = F.coalesce(_c(c), F.lit(""))
    for mark in "’`´":
        x = F.replace(x, F.lit(mark), F.lit("'"))  # far cheaper than a translation by character

    def normal(x: Column) -> Column:
        # one pass: what is not kept is white space, and its runs are one space
        return F.when(x == "nan", "").otherwise(F.trim(F.regexp_replace(_expand(x), r"[^a-z0-9']+", " ")))

    return let(F.trim(F.lower(x)), normal)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tag_lexicon(c: Column | str, collapsed: bool = False) -> Column:
    """Words of the two lexicons replaced by their tags; apostrophes around a word do not count.

    collapsed: the white space of c is single spaces already.
    """

    def tag(w: Column) -> Column:
        bare = F.btrim(w, F.lit("'"))  # membership in a literal list is a hash lookup
        return F.when(bare.isin(*lexicons.GENERIC_NOUNS), lexicons.GENERIC_TAG).when(bare.isin(*lexicons.DOMAIN_NOISE), lexicons.NOISE_TAG).otherwise(w)

    return F.array_join(F.transform(F.split(_c(c) if collapsed else collapse(c), " "), tag), " ")


def tag_count(c: Column | str, tag: str) -> Column:
    return F.regexp_count(_c(c), F.lit(f"\\Q{tag}\\E"))


def tokens(c: Column | str) -> Column:
    """Runs of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(_c(c), F.lit(r"[a-z0-9']+"), F.lit(0))


def unicode_tokens(c: Column | str) -> Column:
    """Words of any script, an inner apostrophe included."""
    return F.regexp_extract_all(_c(c), F.lit(rf"{WORD}+(?:'{WORD}+)?"), F.lit(0))


def token_offsets(c: Column | str) -> Column:
    """array<struct<token,start,stop>>: the words of unicode_tokens and the characters they stand at, from 0, stop exclusive."""
    pattern = rf"{WORD}+(?:'{WORD}+)?"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,stop:int>>").alias("found"))

    def add(state: Column, piece: Column) -> Column:
        # pieces are the words and what stands between them, in order
        stop = state["at"] + F.length(piece)
        word = F.struct(piece.alias("token"), state["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(F.regexp_like(piece, F.lit(f"^{WORD}")), F.concat(state["found"], F.array(word))).otherwise(state["found"]).alias("found"))

    pieces = F.regexp_extract_all(_c(c), F.lit(rf"(?s){pattern}|(?:(?!{WORD}).)+"), F.lit(0))
    return F.aggregate(pieces, start, add, lambda s: s["found"])


def fill_tags(c: Column | str, generic: str = "thing", noise: str = "shipping") -> Column:
    """The tags of both lexicons as plain words."""
    return F.replace(F.replace(_c(c), F.lit(lexicons.GENERIC_TAG), F.lit(generic)), F.lit(lexicons.NOISE_TAG), F.lit(noise))


def word_count(c: Column | str) -> Column:
    """Parts between white space runs; '' has one."""
    return F.size(F.split(_c(c), r"\s+"))


def clean_text(c: Column | str) -> Column:
    return collapse(F.coalesce(_c(c), F.lit("")))


def clean_gold(c: Column | str) -> Column:
    """Gold sentences: the generic tag, line-break tags and the word br out."""
    x = F.replace(_c(c), F.lit(lexicons.GENERIC_TAG), F.lit(" "))
    return collapse(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), r"\bbr\b", " "))


SPAN_MARKS = " \t\n\r.,;:!?()[]{}\"'`"


def normalize_span(c: Column | str) -> Column:
    """White space collapsed, marks off both ends."""
    return F.btrim(collapse(c), F.lit(SPAN_MARKS))


def normalize_aspect(c: Column | str, variant: str = "unicode") -> Column:
    """An aspect for comparison. ascii: all but a-z 0-9 to spaces, capitals too. unicode: lower case,
    _ and marks to spaces. gold: lower case, gold cleaning, all but a-z 0-9 to spaces."""
    x = _c(c)
    if variant == "ascii":
        return collapse(F.regexp_replace(x, r"[^a-z0-9\s]+", " "))
    if variant == "unicode":
        return collapse(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]+", " "))
    if variant == "gold":
        return collapse(F.regexp_replace(clean_gold(F.lower(x)), r"[^a-z0-9\s]+", " "))
    raise ValueError(f"no variant {variant}")


def mark_aspect(sentence: Column | str, aspect: Column | str, append: bool = False) -> Column:
    """The first place of the aspect, case apart, marked; unchanged, or appended, where it does not stand."""
    s, a = _c(sentence), _c(aspect)
    at = F.instr(F.lower(s), F.lower(a))
    mark = F.concat(F.lit("[ASP] "), a, F.lit(" [/ASP]"))
    marked = F.concat(F.substring(s, F.lit(1), at - 1), mark, F.substring(s, at + F.length(a), F.length(s)))
    return F.when(at > 0, marked).otherwise(F.concat(s, F.lit(" "), mark) if append else s)


def context(sentence: Column | str, aspect: Column | str, around: int = 60) -> Column:
    """The aspect with up to `around` characters on both sides; the whole sentence where it does not stand."""
    s, a = _c(sentence), _c(aspect)
    at = F.instr(F.lower(s), F.lower(a))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(s, start, at + F.length(a) + around - start)).otherwise(s)


def percent_text(part: Column, total: Column) -> Column:
    """'n (p%)' with two decimals; 0 of 0 is 0.00%."""
    share = F.coalesce(F.try_divide(part * F.lit(100.0), total), F.lit(0.0))
    return F.concat(part.cast("string"), F.lit(" ("), F.format_string("%.2f", share), F.lit("%)"))


def fill_blank(c: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit(default))


def is_social(c: Column | str) -> Column:
    """Whether the whole text is a phrase of politeness."""
    return F.regexp_like(_c(c), F.lit("^(" + "|".join(f"({p})" for p in lexicons.SOCIAL_PATTERNS) + ")$"))


def is_too_short(c: Column | str) -> Column:
    """Under five characters or two words."""
    return (F.length(_c(c)) < 5) | (word_count(c) < 2)


def asc_input(sentence: Column | str, aspect: Column | str, separator: str = "[SEP]") -> Column:
    return F.concat(_c(sentence), F.lit(f" {separator} "), _c(aspect))


def delete_words(c: Column | str, key: Column, share: float = 0.15, seed: int = 42) -> Column:
    """A part of the words deleted by hash of (key, seed, place): the same on every run and layout.

    Texts of three words or fewer stay; if all words would go, the first stays.
    """
    words = F.split(_c(c), " ")
    kept = F.filter(words, lambda w, i: F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(10_000)) >= int(share * 10_000))
    return F.when(F.size(words) <= 3, _c(c)).when(F.size(kept) == 0, F.get(words, F.lit(0))).otherwise(F.array_join(kept, " "))
