"""Evaluation passages that stand in training texts (problem 9).

Evaluation items go into generalised suffix automata over normalised words. Training texts stream
through: after each word an automaton knows the longest run of words that ends there and stands in
some of its items. Where that run reaches min_words, the state's items are the items leaked.
Spans over which a long run was followed are reported and can be removed.

The texts are read once. The hashes of all runs of min_words words of the items set bits of a filter of
at most FILTER_BITS bits, the only broadcast; texts that hold no such run end there. The others, as a rule
few, go to the automata whose items share a run with them. Items are spread over automata of about
BLOCK_WORDS words, which tasks build from their own items; neither items nor texts pass through the
driver. An automaton that many texts go to is built by several tasks.

Defined results: null and blank texts and items match nothing; items shorter than min_words words
match nothing; items that share a passage are each reported; repeated documents give rows each. Items
of more than BLOCK_WORDS / 2 words are taken in overlapping pieces, whose spans are given one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.llm.text import TAG, words
from opinark.runtime import cut, lookup_join

BLOCK_WORDS = 100_000
#: Words of the texts that one task runs through one automaton, on average.
TASK_WORDS = 2_000_000
#: Bits of the filter: 64 for each run of the items, but no more than this; beyond, more texts pass in vain.
FILTER_BITS = 1 << 29
_SEGMENT = 1 << 20  # bytes of the filter that travel together
_BASE = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """A generalised suffix automaton over words, with the items of each state's long runs."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int) -> None:
        self.min_words = min_words
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        for item, tokens in items:
            last = 0
            for word in tokens:
                last = self._extend(word, last, owners)
                owners[last].add(item)
        # an item of a state also holds all suffixes of its runs
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            up = self.link[state]
            if up > 0 and self.length[up] >= min_words:
                owners[up] |= owners[state]
        self.items = {s: tuple(sorted(o)) for s, o in enumerate(owners) if self.length[s] >= min_words and o}

    def _extend(self, word: str, last: int, owners: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        there = nxt[last].get(word)
        if there is not None:
            if length[there] == length[last] + 1:
                return there
            return self._clone(word, last, there, owners)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        owners.append(set())
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(word, p, q, owners)
        return cur

    def _clone(self, word: str, p: int, q: int, owners: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        owners.append(set())
        link[q] = new
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        return new

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, run, items) at each word where a run of min_words or more ends; end is exclusive."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        state = run = 0
        for end, word in enumerate(tokens, 1):
            while state and word not in nxt[state]:
                state = link[state]
                run = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                run += 1
                if run >= least:
                    at = state
                    while length[link[at]] >= least:  # the state of the last min_words words
                        at = link[at]
                    yield end, run, self.items[at]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def run_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.array([], np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + tokens[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each hash in a filter of so many bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return [(hashes * np.uint64(m) >> np.uint64(21)) & mask for m in (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def item_pieces(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """(item, seq, n): the words of each item that has enough of them, in pieces that overlap by min_words - 1 words."""
    step = BLOCK_WORDS // 2

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["i"], pdf["t"]):
                found = words(t)
                for at in range(0, max(1, len(found) - min_words + 1), step):
                    part = found[at : at + step + min_words - 1]
                    if len(part) >= min_words:
                        out.append((i, " ".join(part), len(part)))
            yield pd.DataFrame(out, columns=["item", "seq", "n"])

    source = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    return source.mapInPandas(read, "item long, seq string, n int")


def _run_filter(pieces: DataFrame, min_words: int, bits: int) -> np.ndarray:
    """The filter as bytes: set for every run of the items. It is put together in tasks, segment by segment."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = np.zeros(bits // 8, np.uint8), _Hashes()
        for pdf in batches:
            for seq in pdf["seq"]:
                for at in _bits(run_hashes(np.array([seen[w] for w in seq.split(" ")], np.uint64), min_words), bits):
                    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = [(k, own[k * _SEGMENT : (k + 1) * _SEGMENT].tobytes()) for k in range(max(1, len(own) // _SEGMENT)) if own[k * _SEGMENT : (k + 1) * _SEGMENT].any()]
        yield pd.DataFrame(parts, columns=["segment", "bits"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(pdf["bits"][0], np.uint8).copy()
        for b in pdf["bits"][1:]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"segment": [pdf["segment"][0]], "bits": [out.tobytes()]})

    # every task makes one filter at most, so tasks are as few as the items allow
    few = pieces.select("seq").coalesce(max(1, min(16, bits // 8 // _SEGMENT)))
    marked = few.mapInPandas(mark, "segment int, bits binary").groupBy("segment").applyInPandas(join, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in marked.toLocalIterator():  # FILTER_BITS / 8 bytes at most
        out[r["segment"] * _SEGMENT : r["segment"] * _SEGMENT + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _candidates(docs: DataFrame, doc_id: str, text: str, shared, min_words: int) -> DataFrame:
    """(d, seq, n, hits): the words of the texts that hold a run the filter knows, and the hashes of these runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, _Hashes()
        bits = len(marks) * 8
        for batch in batches:
            tokens = [words(TAG.sub(" ", t)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in tokens], np.int64)
            # all texts of the batch at once; runs over the end of a text are passed over
            runs = run_hashes(np.array([seen[w] for x in tokens for w in x], np.uint64), min_words)
            known = np.ones(len(runs), bool)
            for at in _bits(runs, bits):
                known &= (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
            hit = np.flatnonzero(known)
            ends = np.cumsum(sizes)
            owner = np.searchsorted(ends, hit, "right")
            inside = hit + min_words <= ends[owner] if len(hit) else np.array([], bool)
            hit, owner = hit[inside], owner[inside]
            which, first = np.unique(owner, return_index=True)
            offsets = pa.array(np.append(first, len(hit)), pa.int32())
            rows = [batch.column(0).take(pa.array(which)), pa.array([" ".join(tokens[k]) for k in which], pa.string())]
            rows += [pa.array(sizes[which], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(runs[hit].view(np.int64)))]
            yield pa.RecordBatch.from_arrays(rows, names=["d", "seq", "n", "hits"])

    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return source.mapInArrow(read, "d long, seq string, n int, hits array<long>")


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 12) -> DataFrame:
    """(doc_id, item_id, word_start, word_end, n_words): runs of min_words words or more that text and item share.

    Overlapping runs of one item are joined; n_words is the number of words of the document.
    """
    spark = docs.sparkSession
    schema = f"{doc_id} long, {item_id} long, word_start int, word_end int, n_words int"
    pieces = cut(item_pieces(items, item_id, item_text, min_words), "item-pieces")
    total, runs = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - min_words + 1), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], schema)
    blocks = math.ceil(total / BLOCK_WORDS)
    # an item may be in pieces: each goes to a block of its own
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "seq"), F.lit(blocks)).cast("int"))
    shared = spark.sparkContext.broadcast(_run_filter(pieces, min_words, min(FILTER_BITS, max(1 << 16, 1 << (64 * runs - 1).bit_length()))))
    # numbered after they are written, so that the number of a text does not change
    found = cut(_candidates(docs, doc_id, text, shared, min_words), "leak-candidates").withColumn("at", F.monotonically_increasing_id())
    if blocks == 1:
        routed = found.select("d", "seq", "n", "at", F.lit(0).alias("block"))
    else:

        def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = _Hashes()
            for pdf in batches:
                got = [np.unique(run_hashes(np.array([seen[w] for w in s.split(" ")], np.uint64), min_words).view(np.int64)) for s in pdf["seq"]]
                yield pd.DataFrame({"hash": np.concatenate(got) if got else np.array([], np.int64), "block": np.repeat(pdf["block"].to_numpy(), [len(x) for x in got])})

        run_blocks = cut(pieces.select("seq", "block").mapInPandas(hashes, "hash long, block int").distinct(), "item-runs")
        to = lookup_join(found.select("at", F.explode("hits").alias("hash")), run_blocks, ["hash"]).select("at", "block").distinct()
        routed = found.select("d", "seq", "n", "at").join(to, "at")
    routed = cut(routed, "leak-routed")
    salts = cut(routed.groupBy("block").agg(F.ceil(F.sum("n") / TASK_WORDS).cast("int").alias("salts")), "leak-salts")
    texts = lookup_join(routed, salts, ["block"]).select("block", F.pmod(F.xxhash64("at"), F.col("salts")).cast("int").alias("salt"), "d", "seq", "n")
    owned = lookup_join(pieces, salts, ["block"]).select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "item", "seq")

    def run(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        automaton = SuffixAutomaton([(i, s.split(" ")) for i, s in zip(own["item"].tolist(), own["seq"])], min_words) if len(own) and len(pdf) else None
        for d, seq, n in zip(pdf["d"], pdf["seq"], pdf["n"]):
            spans: dict[int, list[list[int]]] = {}
            for end, _, got in automaton.matches(seq.split(" ")) if automaton else ():
                for item in got:
                    mine = spans.setdefault(item, [])
                    if mine and mine[-1][1] >= end - min_words:
                        mine[-1][1] = end
                    else:
                        mine.append([end - min_words, end])
            rows.extend((d, item, a, b, n) for item, mine in spans.items() for a, b in mine)
        return pd.DataFrame(rows, columns=[doc_id, item_id, "word_start", "word_end", "n_words"])

    return owned.groupBy("block", "salt").cogroup(texts.groupBy("block", "salt")).applyInPandas(run, schema)


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (word_start, word_end); the rest stays as it is."""
    from opinark.llm.text import WORD

    masked = TAG.sub(lambda m: " " * len(m[0]), text)
    places: list[tuple[int, int]] = []
    end = -1
    for m in WORD.finditer(masked):
        if places and all(c in "'’" for c in masked[end : m.start()]) and m.start() > end:
            places[-1] = (places[-1][0], m.end())  # an apostrophe inside a word
        else:
            places.append(m.span())
        end = m.end()
    out, at = [], 0
    for a, b in sorted(spans):
        if a < len(places):
            start, stop = places[a][0], places[min(b, len(places)) - 1][1]
            if start >= at:
                out.append(text[at:start])
            at = max(at, stop)
    out.append(text[at:])
    return "".join(out)


def cleaned(docs: DataFrame, doc_id: str, text: str, spans: DataFrame, most_coverage: float = 0.5) -> DataFrame:
    """Documents without their leaked spans; those covered beyond most_coverage are left out whole."""
    own = spans.groupBy(doc_id).agg(F.collect_set(F.struct("word_start", "word_end")).alias("spans"), F.max("n_words").alias("n_words"))
    schema = f"{doc_id} long, text string, coverage double, n_spans int"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, found, n in zip(pdf["d"], pdf["t"], pdf["spans"], pdf["n"]):
                got = [] if found is None else sorted((int(s["word_start"]), int(s["word_end"])) for s in found)
                covered, at = 0, 0
                for a, b in got:
                    covered += max(0, b - max(a, at))
                    at = max(at, b)
                share = covered / n if got else 0.0
                if share <= most_coverage:
                    rows.append((d, t if not got else clean_text(t, got), share, len(got)))
            yield pd.DataFrame(rows, columns=[doc_id, "text", "coverage", "n_spans"])

    joined = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(own.select(F.col(doc_id).alias("d"), "spans", F.col("n_words").alias("n")), "d", "left")
    return joined.mapInPandas(read, schema)
