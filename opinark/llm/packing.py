"""Texts put together into packs of fixed capacity (problem 8).

Hierarchical residual packing. Texts are measured in tokens where they are read, and in the same
pass every partition packs its own by best fit, largest first among LOCAL_ITEMS at a time; no text is shuffled. Packs filled
to `nearly_full` are done; all others of a partition stay open for its further texts. Those left are items of a tree of
merges: each node takes the packs left over by FAN neighbouring partitions, with their members listed (a list no longer
than the capacity), packs them by best fit, and hands on those still underfull, up to the root.

A node hands on the emptiest only, MERGE_ITEMS or more, and further ones are packs as they are, so no node gets more than
FAN times as many. That loses no merge: of the packs that best fit makes, no two fit into one, so at most one is half full or
less. Two packs fit into one only if one of them is such; a node gets FAN of these at most, and fills FAN others with them at
most. A node that hands on FAN packs for each level, and two, thus has some left at the root for any that would have fitted
into one that was not handed on. In the end no two packs below `nearly_full` fit into one (tested).

Defined results: null texts and texts without tokens are in no pack; a text longer than the
capacity is cut into full packs and a rest, any other stays whole; equal texts are packed each;
pack sizes must be above zero; rows with the same id are kept apart by their place in the text only,
so ids should be unique.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.runtime import cut

#: Texts that one local best-fit run takes, and rows of one table handed to Spark.
LOCAL_ITEMS = 50_000
#: Packs that a node of the tree hands on for each capacity (more only if the tree is too high for them), and nodes merged into one.
MERGE_ITEMS, FAN = 5_000, 16
#: The rank file is read in the driver and broadcast; it must not be larger.
RANK_BYTES = 64 << 20
_MEMBERS = "array<struct<doc_id:bigint,token_start:int,token_end:int>>"
_SCHEMA = f"pack_name string, capacity int, load int, members {_MEMBERS}, part long, open boolean"


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str):
    """A byte-level tokenizer from the content of a rank file, made once in each worker."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def best_fit(sizes: list[int], capacity: int, loads: Sequence[int] = ()) -> list[list[int]]:
    """Bins of item numbers: largest items first, each into the open bin where it leaves least room.

    A bit set of the residuals of open bins gives the best bin without a search. The first bins are those of loads,
    which hold so much already.
    """
    open_bins: dict[int, list[int]] = {}
    mask = 0
    bins: list[list[int]] = [[] for _ in loads]
    for at, load in enumerate(loads):
        if load < capacity:
            open_bins.setdefault(capacity - load, []).append(at)
    for rest in open_bins:
        mask |= 1 << rest
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fits = mask >> size
        if fits:
            residual = size + (fits & -fits).bit_length() - 1
            own = open_bins[residual]
            at = own.pop()
            if not own:
                mask &= ~(1 << residual)
        else:
            residual, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        rest = residual - size
        if rest:
            open_bins.setdefault(rest, []).append(at)
            mask |= 1 << rest
    return bins


def _packed(capacity: int, items: list[tuple[int, list]], packs: Sequence[tuple[int, list]] = ()) -> list[tuple[int, list]]:
    """Items (size, members) put by best fit into the open packs and further ones, as items again."""
    bins = best_fit([size for size, _ in items], capacity, [load for load, _ in packs])
    held = [*packs, *[(0, [])] * (len(bins) - len(packs))]
    return [(load + sum(items[i][0] for i in b), [*members, *(m for i in b for m in items[i][1])]) if b else (load, members) for (load, members), b in zip(held, bins)]


def _rows(name: str, capacity: int, packs: list[tuple[int, list]], part: int, least: int, most: int) -> list[tuple]:
    """Rows of packs; open are those handed on: filled below `least`, and among the `most` emptiest."""
    under = sorted((load, k) for k, (load, _) in enumerate(packs) if load < least)[:most]
    handed_on = {k for _, k in under}
    return [(name, capacity, load, members, part, k in handed_on) for k, (load, members) in enumerate(packs)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["pack_name", "capacity", "load", "members", "part", "open"])
    out["members"] = [[{"doc_id": d, "token_start": a, "token_end": b} for d, a, b in m] for m in out["members"]]
    return out


def pack(docs: DataFrame, doc_id: str, text: str, sizes: list[tuple[str, int]], tokenizer_path: str, pattern: str, nearly_full: float = 0.99) -> DataFrame:
    """(pack_name, capacity, load, members): the packs of every size; members (doc_id, token_start, token_end)."""
    if any(capacity < 1 for _, capacity in sizes):
        raise ValueError("a pack must hold one token at least")
    with open(tokenizer_path, "rb") as f:
        ranks = f.read(RANK_BYTES + 1)
    if len(ranks) > RANK_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {RANK_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    least = {capacity: math.ceil(capacity * nearly_full) for _, capacity in sizes}
    handed = max(MERGE_ITEMS, FAN * math.ceil(31 / math.log2(FAN)) + 2)  # the levels of a tree of 2^31 partitions

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(shared.value, pattern).encode_ordinary
        part = TaskContext.get().partitionId()
        held: list[tuple[int, int]] = []
        left: list[list[tuple[int, list]]] = [[] for _ in sizes]  # underfull packs, open for further texts
        for pdf in batches:
            held.extend((int(d), len(encode(t))) for d, t in zip(pdf["d"], pdf["t"]))
            if len(held) >= LOCAL_ITEMS:
                yield from frames(run(held, left, part))
                held = []
        yield from frames(run(held, left, part))
        for (name, capacity), packs in zip(sizes, left):
            yield from frames(_rows(name, capacity, packs, part, least[capacity], handed))

    def frames(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for at in range(0, len(rows), LOCAL_ITEMS):
            yield _frame(rows[at : at + LOCAL_ITEMS])

    def run(held: list[tuple[int, int]], left: list[list[tuple[int, list]]], part: int) -> list[tuple]:
        """Rows of the packs that held texts fill; all others are in left."""
        rows: list[tuple] = []
        for k, (name, capacity) in enumerate(sizes):
            items = []
            for d, n in held:
                full = n // capacity
                rows.extend((name, capacity, capacity, [(d, j * capacity, (j + 1) * capacity)], part, False) for j in range(full))
                if n % capacity:
                    items.append((n % capacity, [(d, full * capacity, n)]))
            packs = _packed(capacity, items, left[k])
            rows.extend((name, capacity, load, members, part, False) for load, members in packs if load >= least[capacity])
            left[k] = [p for p in packs if p[0] < least[capacity]]
        return rows

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity = pdf["pack_name"][0], int(pdf["capacity"][0])
        items = sorted((int(load), [(m["doc_id"], m["token_start"], m["token_end"]) for m in members]) for load, members in zip(pdf["load"], pdf["members"]))
        return _frame(_rows(name, capacity, _packed(capacity, items), int(pdf["part"][0]), least[capacity], handed))

    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    packs = cut(source.mapInPandas(first, _SCHEMA), "packs")
    nodes = (packs.agg(F.max("part")).first()[0] or 0) + 1
    done = []
    while nodes > 1:
        done.append(packs.where("not open"))
        above = packs.where("open").withColumn("part", F.expr(f"part div {FAN}"))
        packs = cut(above.groupBy("part", "pack_name", "capacity").applyInPandas(merge, _SCHEMA), "packs")
        nodes = math.ceil(nodes / FAN)
    out = packs
    for d in done:
        out = out.unionByName(d)
    return out.select("pack_name", "capacity", "load", "members")


def pack_rows(packs: DataFrame) -> DataFrame:
    """(pack_name, pack_id, doc_id, token_start, token_end): one row per text piece; pack_id is its first piece."""
    lead = F.col("members")[0]
    named = packs.withColumn("pack_id", F.concat(lead["doc_id"].cast("string"), F.lit(":"), lead["token_start"].cast("string")))
    return named.select("pack_name", "pack_id", F.explode("members").alias("m")).select("pack_name", "pack_id", "m.doc_id", "m.token_start", "m.token_end")
