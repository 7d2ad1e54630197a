"""Several values packed in one text field: learn the column's values, then split by them.

A packed field holds a list as text, in an unknown notation: bracketed or bare, with any of
several separators, items quoted or not. Each field is read as a lattice whose nodes are the
possible item boundaries: one chain of pieces for each separator the field may use, as producers
never mix them. A quoted span is one atomic piece. An edge is a value: one piece, or several with
the separators between them where the field must have fewer places than pieces.

Two columns of a row may be declared parallel (a label list and its score list): a path through both
lattices has equally many places in either. Where no pair of chains has, edges over several pieces are
added to both; where that does not help either, the columns are split each by itself.

Expectation-maximisation learns from the whole column how often each value occurs: the forward-backward
pass over a row's lattices gives the expected count of each edge. Viterbi then keeps the best path. Lattices
with one path need no rates, so only the others' edges meet the value table.

Defined results: null, blank and empty-list fields give no rows; an empty place between
separators takes a position and gives no row; repeated values are all listed; fields in which no
path fits the value type are given as one value; of equally likely paths the one with more places is kept,
then that of the first separator; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.runtime import cut, lookup_join

SEPARATORS = (",", ";", "|", "/", "\t")
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
#: A quote that closes and opens again around a separator: the span holds several items.
_REOPENED = {q: re.compile(rf"(?<!\\){re.escape(c)}(\s*[,;|/\t]\s*|\s+){re.escape(q)}") for q, c in _QUOTES.items()}
_NUMBER = re.compile(r"[-+]?(\d+([.,]\d*)?|[.,]\d+)([eE][-+]?\d+)?")
#: Pieces that one value may take beyond the mean that the places ask for.
WIDER = 8


def _quoted(s: str, i: int, sep: str | None) -> tuple[str, int] | None:
    """The value and end of a quoted span that starts at i and is closed before a separator or the end."""
    close, out, k, n = _QUOTES[s[i]], [], i + 1, len(s)
    while k < n:
        c = s[k]
        if c == "\\" and k + 1 < n and s[k + 1] in "\\'\"":
            out.append(s[k + 1])
            k += 2
        elif c == close:
            if k + 1 < n and s[k + 1] == close and close == '"' and _more_quotes(s, k + 2, sep):
                out.append(c)
                k += 2
                continue
            after = k + 1
            while after < n and _blank(s[after], sep):
                after += 1
            if after == n or (sep == " " and after > k + 1) or s[after] == sep:
                return None if _REOPENED[s[i]].search(s, i + 1, k) else ("".join(out), k + 1)
            out.append(c)
            k += 1
        else:
            out.append(c)
            k += 1
    return None


def _blank(c: str, sep: str | None) -> bool:
    """White space that separates nothing, or any white space where that is the separator."""
    return c.isspace() and (sep == " " or c != sep)


def _more_quotes(s: str, k: int, sep: str | None) -> bool:
    """Whether a doubled quote before k can be an escape: a closing quote must still follow."""
    return s.find('"', k) >= 0


@lru_cache(maxsize=50_000)
def _pieces(s: str, sep: str | None) -> tuple[tuple[str, bool], ...]:
    """Items of s between unquoted separators, each with whether it was quoted; sep " " is any white space."""
    out: list[tuple[str, bool]] = []
    i, n = 0, len(s)
    while True:
        while i < n and _blank(s[i], sep):
            i += 1
        if sep == " " and i >= n:
            break
        value, quoted = "", False
        if i < n and s[i] in _QUOTES and (got := _quoted(s, i, sep)):
            value, i, quoted = got[0].strip(), got[1], True
            while i < n and _blank(s[i], sep):
                i += 1
        else:
            k = i
            while k < n and not (s[k] == sep or (sep == " " and s[k].isspace())):
                k += 1
            value, i = s[i:k].strip(), k
        out.append((value, quoted))
        if i >= n:
            break
        i += sep != " "
        if i >= n and sep != " ":
            out.append(("", False))
            break
    return tuple(out)


def number_text(value: str) -> str | None:
    """A decimal with point and exactly four places, "nan", "" for an empty place; None for no number."""
    low = value.strip().lower()
    if low in ("", "none", "null"):
        return ""
    if low in ("nan", "+nan", "-nan"):
        return "nan"
    if not _NUMBER.fullmatch(low):
        return None
    try:
        return str(Decimal(low.replace(",", ".")).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))
    except InvalidOperation:
        return None


class Chain(NamedTuple):
    """The readings of a field by one separator: `nodes` boundaries after the first, and edges (from, to, value).

    ways: how many paths it has, by their number of places.
    """

    nodes: int
    edges: tuple[tuple[int, int, str], ...]
    ways: dict[int, int]


@lru_cache(maxsize=50_000)
def lattice(field: str | None, numeric: bool, widest: int = 1) -> tuple[Chain, ...]:
    """The chains of one field, values clean with "" for empty places, edges over `widest` pieces at most; none if it holds no list."""
    s = (field or "").strip()
    if not s:
        return ()
    bodies = []
    if s[0] == "[" and s[-1] == "]":
        inner = s[1:-1]
        if not inner.strip():
            return ()
        bodies.append((inner, True))
    if not bodies or "]" in s[1:-1]:
        bodies.append((s, False))
    found: dict[tuple, Chain] = {}
    for body, bracketed in bodies:
        for sep in (None, *SEPARATORS, " "):
            if sep == " " and not (bracketed or numeric):
                continue
            if sep not in (None, " ") and sep not in body:
                continue
            got = _pieces(body, sep)
            if sep == " " and not all(q or numeric for _, q in got):
                continue
            if bracketed and numeric is False and sep is None and not got[0][1] and got[0][0].count("'") > 2:
                continue
            edges = [(k, k + 1, _clean(v, q, numeric)) for k, (v, q) in enumerate(got)]
            if sep not in (None, " "):
                for a in range(len(got)):
                    for b in range(a + 2, min(a + widest, len(got)) + 1):
                        if got[a][1] or got[b - 1][1]:
                            break  # a quoted span is a value of its own
                        edges.append((a, b, _clean(sep.join(v for v, _ in got[a:b]), False, numeric)))
            known = tuple(e for e in edges if e[2] is not None)
            if ways := _ways(len(got), known):
                found.setdefault(known, Chain(len(got), known, ways))
    return tuple(found.values()) or (Chain(1, ((0, 1, s),), {1: 1}),)


def _ways(nodes: int, edges: tuple[tuple[int, int, str], ...]) -> dict[int, int]:
    if len(edges) <= nodes:  # pieces only: one path, if it is whole
        return {nodes: 1} if len(edges) == nodes and all(e[1] == k + 1 for k, e in enumerate(edges)) else {}
    at: list[dict[int, int]] = [{0: 1}] + [{} for _ in range(nodes)]
    for a, b, _ in sorted(edges):
        for n, k in at[a].items():
            at[b][n + 1] = at[b].get(n + 1, 0) + k
    return at[-1]


def _places(chains: tuple[Chain, ...]) -> dict[int, int]:
    """How many paths a field's lattice has, by their number of places."""
    out: dict[int, int] = {}
    for chain in chains:
        for n, k in chain.ways.items():
            out[n] = out.get(n, 0) + k
    return out


def row_lattices(a: str | None, b: str | None, numeric: tuple[bool, bool], parallel: bool) -> tuple[tuple[Chain, ...], tuple[Chain, ...], list[int] | None]:
    """The lattices of a row's two fields, and the numbers of places both may have; None if they are split apart."""
    left, right = lattice(a, numeric[0]), lattice(b, numeric[1])
    if not parallel or not left or not right:
        return left, right, None
    na, nb = _places(left), _places(right)
    if both := sorted(na.keys() & nb.keys()):
        return left, right, both
    most, least = max(*na, *nb), min(*na, *nb)
    wide = [lattice(f, x, math.ceil(most / least) + WIDER) for f, x in zip((a, b), numeric)]
    both = sorted((_places(wide[0]).keys() & nb.keys()) | (na.keys() & _places(wide[1]).keys()))
    return (*wide, both) if both else (left, right, None)


def _tables(chain: Chain, rate, join) -> tuple[list[dict[int, float]], list[dict[int, float]]]:
    """Weights of all ways from the start to each node, and from each node to the end, by places; weights are logarithms."""
    ahead: list[dict[int, float]] = [{0: 0.0}] + [{} for _ in range(chain.nodes)]
    behind: list[dict[int, float]] = [{} for _ in range(chain.nodes)] + [{0: 0.0}]
    edges = sorted(chain.edges)
    for a, b, v in edges:
        for n, w in ahead[a].items():
            x = w + rate(v)
            ahead[b][n + 1] = join(ahead[b][n + 1], x) if n + 1 in ahead[b] else x
    for a, b, v in sorted(edges, key=lambda e: -e[1]):
        for n, w in behind[b].items():
            x = w + rate(v)
            behind[a][n + 1] = join(behind[a][n + 1], x) if n + 1 in behind[a] else x
    return ahead, behind


def _log_sum(a: float, b: float) -> float:
    hi, lo = (a, b) if a > b else (b, a)
    return hi + math.log1p(math.exp(lo - hi))


def expected(fields: tuple[tuple[Chain, ...], ...], allowed: list[int] | None, rates) -> list[tuple[int, str, float]]:
    """(field, value, expected count) by the forward-backward pass over a row's lattices; rates[f](value) is a logarithm."""
    tables = [[_tables(c, rates[f], _log_sum) for c in chains] for f, chains in enumerate(fields)]
    totals: list[dict[int, float]] = []
    for of_field in tables:
        total: dict[int, float] = {}
        for ahead, _ in of_field:
            for n, w in ahead[-1].items():
                total[n] = _log_sum(total[n], w) if n in total else w
        totals.append(total)
    out = []
    for f, chains in enumerate(fields):
        if not chains:
            continue
        # the weight of the other field's paths with as many places
        other = {n: totals[1 - f][n] for n in allowed if n in totals[1 - f] and n in totals[f]} if allowed is not None else dict.fromkeys(totals[f], 0.0)
        whole = None
        for n, w in other.items():
            whole = totals[f][n] + w if whole is None else _log_sum(whole, totals[f][n] + w)
        for chain, (ahead, behind) in zip(chains, tables[f]):
            for a, b, v in chain.edges:
                p = sum(math.exp(x + rates[f](v) + y + other[n + m + 1] - whole) for n, x in ahead[a].items() for m, y in behind[b].items() if n + m + 1 in other)
                if p > 1e-9:
                    out.append((f, v, p))
    return out


def viterbi(fields: tuple[tuple[Chain, ...], ...], allowed: list[int] | None, rates) -> list[tuple[str, ...]]:
    """The values of the best path through both lattices of a row."""
    best: list[dict[int, tuple[float, tuple]]] = []
    for f, chains in enumerate(fields):
        found: dict[int, tuple[float, tuple]] = {}
        for chain in chains:
            at: list[dict[int, tuple[float, tuple]]] = [{0: (0.0, ())}] + [{} for _ in range(chain.nodes)]  # values as nested pairs
            for a, b, v in sorted(chain.edges):
                for n, (w, way) in at[a].items():
                    if n + 1 not in at[b] or w + rates[f](v) > at[b][n + 1][0]:
                        at[b][n + 1] = (w + rates[f](v), (way, v))
            for n, got in at[-1].items():
                if n not in found or got[0] > found[n][0] + 1e-12:
                    found[n] = got
        best.append(found)
    if allowed is not None:
        n = max((n for n in allowed if n in best[0] and n in best[1]), key=lambda n: (round(best[0][n][0] + best[1][n][0], 9), n))
        picked = [best[0][n][1], best[1][n][1]]
    else:
        picked = [max(x.items(), key=lambda e: (round(e[1][0], 9), e[0]))[1][1] if x else () for x in best]
    out = []
    for way in picked:
        values = []
        while way:
            way, v = way
            values.append(v)
        out.append(tuple(reversed(values)))
    return out


def _single(chains: tuple[Chain, ...], allowed: list[int] | None) -> tuple[str, ...] | None:
    """The values of a lattice's path where it is the only one of pieces; what Viterbi gives, without a search."""
    if not chains:
        return ()
    own = [c for c in chains if allowed is None or any(n in c.ways for n in allowed)]
    return tuple(v for _, _, v in own[0].edges) if len(own) == 1 and len(own[0].edges) == own[0].nodes else None


def _one_path(fields: tuple[tuple[Chain, ...], ...], allowed: list[int] | None) -> bool:
    na, nb = map(_places, fields)
    if allowed is not None:
        return sum(na.get(n, 0) * nb.get(n, 0) for n in allowed) == 1
    return sum(na.values()) <= 1 and sum(nb.values()) <= 1


def _clean(value: str, quoted: bool, numeric: bool) -> str | None:
    if numeric:
        return number_text(value)
    if not quoted and value in ("None", "nan", "NaN", "null"):
        return ""
    return value


def shape(value: str, numeric: bool) -> str:
    """What EM counts for a value: itself, or for a number the pattern of its integer part."""
    return value if not numeric else ("nan" if value == "nan" else value.partition(".")[0])


def split_packed(
    rows: DataFrame,
    key: str,
    fields: tuple[str, str],
    numeric: tuple[bool, bool] = (False, False),
    parallel: bool = True,
    em_rounds: int = 3,
    smoothing: float = 0.01,
) -> DataFrame:
    """One row per value of two packed columns: (key, field_name, pos, item_value), pos from 1.

    key must be unique. The value table is counted before it is broadcast and joined by shuffle when it is large.
    """
    key_type = rows.schema[key].dataType.simpleString()
    zero = (lambda v: 0.0, lambda v: 0.0)

    def text(x) -> str | None:
        return x if isinstance(x, str) else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {"a": [], "b": [], "sure": []}
            for a, b in zip(pdf["a"], pdf["b"]):
                *both, allowed = row_lattices(text(a), text(b), numeric, parallel)
                sure = _one_path(tuple(both), allowed)
                left, right = (_single(c, allowed) for c in both) if sure else ((), ())
                if left is None or right is None:
                    left, right = viterbi(tuple(both), allowed, zero)
                out["a"].append(list(left))
                out["b"].append(list(right))
                out["sure"].append(sure)
            yield pd.DataFrame({"k": pdf["k"], "a": out["a"], "b": out["b"], "sure": out["sure"], "ta": pdf["a"].where([not s for s in out["sure"]], None), "tb": pdf["b"].where([not s for s in out["sure"]], None)})

    source = rows.select(F.col(key).alias("k"), F.col(fields[0]).alias("a"), F.col(fields[1]).alias("b"))
    ran = cut(source.mapInPandas(read, f"k {key_type}, a array<string>, b array<string>, sure boolean, ta string, tb string"), "lattice")

    def counted(name: str, index: int) -> DataFrame:
        v = F.when(F.col("v") == "nan", "nan").otherwise(F.substring_index("v", ".", 1)) if numeric[index] else F.col("v")
        return ran.where("sure").select(F.explode(name).alias("v")).where("v <> ''").select(F.lit(index).alias("field"), v.alias("value"))

    sure = counted("a", 0).unionByName(counted("b", 1)).groupBy("field", "value").agg(F.count("*").cast("double").alias("mass"))
    sure = cut(sure, "sure-values")
    unsure = ran.where("not sure").select("k", "ta", "tb")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for k, a, b in zip(pdf["k"], pdf["ta"], pdf["tb"]):
                *both, _ = row_lattices(text(a), text(b), numeric, parallel)
                found.extend((k, f, v) for f, chains in enumerate(both) for v in {shape(v, numeric[f]) for c in chains for _, _, v in c.edges})
            yield pd.DataFrame(found, columns=["k", "field", "value"])

    # the values that the open lattices ask rates for
    asked = cut(unsure.mapInPandas(edges, f"k {key_type}, field int, value string"), "open-values")

    def rated(table: DataFrame) -> DataFrame:
        """(k, ta, tb, rates) of the open rows; rates holds the logarithms for all values of their edges."""
        totals = table.groupBy("field").agg(F.sum("mass").alias("total"), F.count("*").alias("kinds"))
        share = F.log((F.coalesce("mass", F.lit(0.0)) + smoothing) / (F.coalesce("total", F.lit(0.0)) + smoothing * (F.coalesce("kinds", F.lit(0)) + 1)))
        rates = lookup_join(asked, table, ["field", "value"], "left").join(F.broadcast(totals), "field", "left")  # two rows at most
        listed = rates.groupBy("k").agg(F.collect_list(F.struct("field", "value", share.alias("rate"))).alias("rates"))
        return unsure.join(listed, "k", "left")

    def with_rates(pdf: pd.DataFrame) -> Iterator[tuple]:
        for k, a, b, listed in zip(pdf["k"], pdf["ta"], pdf["tb"], pdf["rates"]):
            *both, allowed = row_lattices(text(a), text(b), numeric, parallel)
            known = {(r["field"], r["value"]): r["rate"] for r in (listed if listed is not None else ())}
            yield k, tuple(both), allowed, tuple(lambda v, f=f: known.get((f, shape(v, numeric[f])), 0.0) if v else 0.0 for f in (0, 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mass: dict[tuple[int, str], float] = {}
            for _, both, allowed, rates in with_rates(pdf):
                for f, v, p in expected(both, allowed, rates):
                    if v:
                        mass[f, shape(v, numeric[f])] = mass.get((f, shape(v, numeric[f])), 0.0) + p
            yield pd.DataFrame([(*k, p) for k, p in mass.items()], columns=["field", "value", "mass"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, *map(list, viterbi(both, allowed, rates))) for k, both, allowed, rates in with_rates(pdf)]
            yield pd.DataFrame(got, columns=["k", "a", "b"])

    table = sure
    for _ in range(em_rounds):
        learned = rated(table).mapInPandas(count, "field int, value string, mass double")
        table = cut(sure.unionByName(learned).groupBy("field", "value").agg(F.sum("mass").alias("mass")), "value-table")
    chosen = ran.where("sure").select("k", "a", "b").unionByName(rated(table).mapInPandas(choose, f"k {key_type}, a array<string>, b array<string>"))
    listed = chosen.select("k", F.explode(F.array(F.struct(F.lit(fields[0]).alias("f"), F.col("a").alias("vs")), F.struct(F.lit(fields[1]).alias("f"), F.col("b").alias("vs")))).alias("s"))
    out = listed.select(F.col("k").alias(key), F.col("s.f").alias("field_name"), F.posexplode("s.vs").alias("p0", "item_value"))
    return out.where("item_value <> ''").select(key, "field_name", (F.col("p0") + 1).cast("int").alias("pos"), "item_value")
