"""Aspect spans: token labels to spans and back, all as higher-order functions within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinark.functions import text as X
from opinark.functions.text import let

B, I, O = "B-ASP", "I-ASP", "O"  # noqa: E741


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_spans(labels: Column | str) -> Column:
    """array<struct<start,end>> of label runs: B begins, I goes on, an I without B is no span."""
    return let(_c(labels), _index_spans)


def _index_spans(ls: Column) -> Column:
    """A span goes from a B to the place before the next label other than I."""
    n = F.size(ls)
    others = F.filter(F.transform(ls, lambda x, i: F.when(x != I, i)), lambda i: i.isNotNull())

    def between(places: Column) -> Column:
        spans = F.transform(places, lambda p, j: F.struct(p.cast("int").alias("start"), (F.get(places, j + 1) - 1).cast("int").alias("end")))
        return F.filter(spans, lambda s: F.get(ls, s["start"]) == B)

    return F.when(n > 0, let(F.concat(others, F.array(n)), between)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def decode_spans(tokens: Column | str, labels: Column | str, confidences: Column | str) -> Column:
    """array<struct<aspect,confidence,start,end>>: confidence is the mean of the tokens'; blank aspects are left out."""
    ts, cs = _c(tokens), _c(confidences)

    def fill(s: Column) -> Column:
        n = s["end"] - s["start"] + 1
        total = F.aggregate(F.slice(cs, s["start"] + 1, n), F.lit(0.0), lambda a, x: a + x)
        return F.struct(
            X.normalize_span(F.array_join(F.slice(ts, s["start"] + 1, n), " ")).alias("aspect"), (total / n).alias("confidence"), s["start"].alias("start"), s["end"].alias("end")
        )

    return F.filter(F.transform(index_spans(labels), fill), lambda s: s["aspect"] != "")


def best_spans(spans: Column | str) -> Column:
    """One span per aspect, the most confident (the first on ties), in order of confidence, then aspect."""

    def order(a: Column, b: Column) -> Column:
        return (
            F.when(a["confidence"] > b["confidence"], -1)
            .when(a["confidence"] < b["confidence"], 1)
            .when(a["aspect"] < b["aspect"], -1)
            .when(a["aspect"] > b["aspect"], 1)
            .when(a["start"] < b["start"], -1)
            .otherwise(F.when(a["start"] > b["start"], 1).otherwise(0))
        )

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda s, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda x: x["aspect"] == s["aspect"]))

    return let(F.array_sort(_c(spans), order), firsts)


def is_gold(confidences: Column | str) -> Column:
    """All known confidences are .999 or more, and there is one."""
    known = F.filter(F.coalesce(_c(confidences), F.array().cast("array<double>")), lambda c: c.isNotNull() & ~F.isnan(c))
    return (F.size(known) > 0) & F.forall(known, lambda c: c >= 0.999)


def confidence_weight(confidence: Column, gold: Column, floor: float = 0.85, low: float = 0.6, high: float = 0.9) -> Column:
    """Loss weight of an aspect token: 1 in gold rows, else linear between low and high above the floor."""
    c = F.when(confidence.isNull() | F.isnan(confidence), floor).otherwise(F.least(F.greatest(confidence, F.lit(floor)), F.lit(1.0)))
    return F.when(gold, 1.0).otherwise(low + (c - floor) / (1.0 - floor) * (high - low))


def _starts(norm: Column, words: Column) -> Column:
    """Places where the words stand in a row of tokens in normal form; none for no words."""
    n = F.size(words)
    last = F.size(norm) - n
    first = F.get(words, F.lit(0))
    return F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda s: (n > 0) & (s <= last) & (F.get(norm, s) == first) & (F.slice(norm, s + 1, n) == words))


def label_tokens(tokens: Column | str, aspects: Column | str, confidences: Column | str | None = None, first_only: bool = False) -> Column:
    """array<struct<label,weight>>, one per token: every place where an aspect's tokens stand; later aspects win.

    Tokens are compared in the normal form of aspects. first_only labels the first place alone.
    """
    asp = F.coalesce(_c(aspects), F.array().cast("array<string>"))
    conf = F.coalesce(_c(confidences), F.array().cast("array<double>")) if confidences is not None else F.array().cast("array<double>")
    norm = F.transform(_c(tokens), lambda t: X.normalize_aspect(t))
    listed = F.transform(asp, lambda a, k: F.struct(k.alias("k"), X.unicode_tokens(X.normalize_aspect(a)).alias("words"), F.get(conf, k).alias("conf")))

    def hits(norm: Column, listed: Column) -> Column:
        def of(a: Column) -> Column:
            starts = _starts(norm, a["words"])
            if first_only:
                starts = F.slice(starts, 1, 1)
            return F.transform(starts, lambda s: F.struct(a["k"].alias("k"), s.alias("s"), F.size(a["words"]).alias("n"), a["conf"].alias("conf")))

        return F.flatten(F.transform(listed, of))

    def label(norm: Column, found: Column, gold: Column) -> Column:
        def of(i: Column) -> Column:
            over = F.array_max(F.filter(found, lambda h: (h["s"] <= i) & (i < h["s"] + h["n"])))
            return let(
                over,
                lambda h: F.struct(
                    F.when(h.isNull(), O).when(h["s"] == i, B).otherwise(I).alias("label"),
                    F.when(h.isNull(), F.when(gold, 1.0).otherwise(0.15)).otherwise(confidence_weight(h["conf"], gold)).alias("weight"),
                ),
            )

        return F.when(F.size(norm) > 0, F.transform(F.sequence(F.lit(0), F.size(norm) - 1), of)).otherwise(F.array().cast("array<struct<label:string,weight:double>>"))

    return let(norm, lambda n: let(let(listed, lambda ls: hits(n, ls)), lambda h: let(is_gold(conf), lambda g: label(n, h, g))))


def unmatched_aspects(tokens: Column | str, aspects: Column | str) -> Column:
    """The aspects whose tokens stand nowhere in the sentence; aspects without tokens are neither."""
    norm = F.transform(_c(tokens), lambda t: X.normalize_aspect(t))

    def missing(norm: Column, a: Column) -> Column:
        return let(X.unicode_tokens(X.normalize_aspect(a)), lambda words: (F.size(words) > 0) & (F.size(_starts(norm, words)) == 0))

    return let(norm, lambda n: F.filter(F.coalesce(_c(aspects), F.array().cast("array<string>")), lambda a: missing(n, a)))


def first_subtoken(word_ids: Column | str, values: Column | str) -> Column:
    """One value per word: that of its first sub-token; sub-tokens without word are left out."""

    def firsts(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda p, i: p["w"].isNotNull() & ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["w"].eqNullSafe(p["w"])))
        return F.transform(kept, lambda p: p["v"])

    return let(F.arrays_zip(_c(word_ids).alias("w"), _c(values).alias("v")), firsts)


def zip_pairs(aspects: Column | str, opinions: Column | str) -> Column:
    """Aspects and opinions paired by place, as far as both go."""
    a, o = _c(aspects), _c(opinions)
    n = F.least(F.size(a), F.size(o))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("aspect"), F.slice(o, F.lit(1), n).alias("opinion"))


def label_by_characters(sentence: Column | str, aspects: Column | str) -> Column:
    """array<struct<token,label>>: the first place of each aspect's characters, case apart; later aspects win.

    White space is collapsed first. Tokens that lie whole inside the aspect's characters are labelled. Where the
    aspect does not stand, its first word is looked for instead, and as many characters are taken from there.
    """
    text = X.clean_text(sentence)

    def place(low: Column, aspect: Column) -> Column:
        head = F.get(X.unicode_tokens(aspect), F.lit(0))
        at = F.instr(low, aspect)
        found = F.when(at > 0, at).otherwise(F.coalesce(F.instr(low, head), F.lit(0)))
        return F.when((aspect != "") & (found > 0), F.struct((found - 1).alias("a"), (found - 1 + F.length(aspect)).alias("b")))

    def label(ts: Column, places: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            over = F.filter(places, lambda p: (t["start"] >= p["a"]) & (t["stop"] <= p["b"]))
            last = F.get(over, F.size(over) - 1)  # the last aspect over this token
            first = (i == 0) | (F.get(ts, i - 1)["start"] < last["a"])
            return F.struct(t["token"].alias("token"), F.when(last.isNull(), O).when(first, B).otherwise(I).alias("label"))

        return F.transform(ts, of)

    def both(s: Column) -> Column:
        listed = F.transform(F.coalesce(_c(aspects), F.array().cast("array<string>")), lambda a: F.lower(X.clean_text(a)))
        places = let(F.lower(s), lambda low: F.filter(F.transform(listed, lambda a: place(low, a)), lambda p: p.isNotNull()))
        return let(X.token_offsets(s), lambda ts: let(places, lambda ps: label(ts, ps)))

    return let(text, both)


def label_with_opinions(sentence: Column | str, triplets: Column | str) -> Column:
    """array<string>, one label per white-space token: B-ASP and I-ASP at every place of an aspect, B-OPI-POS and the like at every
    place of an opinion. Of several labels the last written stays: by triplet, the aspect before the opinion, then by place."""
    tokens = F.filter(F.split(X.clean_text(sentence), " "), lambda t: t != "")
    empty = F.array().cast("array<struct<aspect:string,opinion:string,sentiment:int>>")

    def phrases(t: Column) -> Column:
        polarity = F.when(t["sentiment"] == 2, "POS").when(t["sentiment"] == 0, "NEG").otherwise("NEU")
        split = lambda c: F.filter(F.split(X.clean_text(c), " "), lambda w: w != "")
        return F.array(F.struct(split(t["aspect"]).alias("words"), F.lit("ASP").alias("tag")), F.struct(split(t["opinion"]).alias("words"), F.concat(F.lit("OPI-"), polarity).alias("tag")))

    listed = F.flatten(F.transform(F.coalesce(_c(triplets), empty), phrases))

    def hits(ts: Column) -> Column:
        of = lambda p, k: F.transform(_starts(ts, p["words"]), lambda s: F.struct(k.alias("k"), s.alias("s"), F.size(p["words"]).alias("n"), p["tag"].alias("tag")))
        return F.flatten(F.transform(listed, of))

    def label(ts: Column, found: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            over = F.array_max(F.filter(found, lambda h: (h["s"] <= i) & (i < h["s"] + h["n"])))
            return let(over, lambda h: F.when(h.isNull(), O).otherwise(F.concat(F.when(h["s"] == i, "B-").otherwise("I-"), h["tag"])))

        return F.transform(ts, of)

    return let(tokens, lambda ts: let(hits(ts), lambda h: label(ts, h)))
