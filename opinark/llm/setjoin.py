"""Links between rows whose word sets are alike: an exact, connectivity-keeping set join.

Likeness is the Jaccard measure of word sets, with a rational threshold. Two rows at or above it
share a word among the rarest few of each (prefix filtering), two such words among one more of
each, and so on. So rows meet in groups by a prefix word, and by two, three ... prefix words where
the group by fewer would be large. The order of words is by document frequency: the TOP_WORDS most
frequent words are counted exactly and broadcast (the only broadcast, of fixed size); all others
count as rarer and are ordered by hash.

Links found are a subgraph of all links with the same connected groups: within a task, two rows that
are connected already are not compared again. A group of look-alikes of any size thus costs about
one comparison and one link per row and task rather than one per pair, and no link between
separate groups is ever lost. Exact copies collapse map-side to one row per map task first.

A partition that many more rows than estimated come to, as a large family of near-copies shares all its words, is
counted before the join and cut into blocks; every two blocks meet in a task of their own, so no task grows
with the family and no link is lost. That costs the square of the family's size over MAX_TASK_ROWS.

Rows travel once per prefix partition as compressed column blocks. Rows that would meet by a word
of more than MAX_TASK_ROWS rows meet by pairs of words instead, by triples, and so on. Short sets whose
partners may share no further word stay in the group by fewer words as well.

Pairs of words are many: 45 of ten words. So words are put into classes, and only pairs within a class are
groups: of any c + 1 words that two rows share, two are of one of c classes. Prefixes are longer by c - 1 words
for that. The number of classes that sends rows to the fewest partitions is found on a sample. It
decides only the cost, as do the number of partitions and that of waves: rows that would go to more than
MAX_COPIES partitions on average are sent to WAVE_COPIES of them at a time, so that what lies on disk at once
does not grow with the partitions a row goes to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinark.llm.text import words
from opinark.runtime import cut, discard, lookup_join

TOP_WORDS = 60_000
MAX_TASK_ROWS = 100_000
MAX_DEPTH = 6
#: A partition of so many times MAX_TASK_ROWS rows is met in blocks.
OVERFULL = 3
#: Partitions at least, so that a row goes to as many of them in small tables as in large ones.
MIN_PARTS = 96
#: Partitions that a row goes to at once, on average; and in one wave, if they are more.
MAX_COPIES, WAVE_COPIES = 10, 6
#: Rows of the sample that tells how many they are, about.
SAMPLE_ROWS = 4_000
#: Numbers of classes that are tried.
CLASSES = (1, 2, 3, 4)
#: Rows that are grouped at once, and rows of one block before it is split by partition.
GROUPED_ROWS, BLOCK_ROWS = 1 << 14, MAX_TASK_ROWS // 2
#: Groups up to this size are compared pair by pair; larger ones are split by a further word.
SMALL_GROUP = 40
_SIGN = np.int64(-(2**63))
_RARE_KEY = np.uint64(1 << 43)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Likeness:
    """A Jaccard threshold num/den."""

    num: int = 7
    den: int = 10

    def holds(self, inter: np.ndarray, total: np.ndarray) -> np.ndarray:
        return inter * (self.num + self.den) >= self.num * total

    def most_different(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of two sets with so many words together."""
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def least_shared(self, n: np.ndarray) -> np.ndarray:
        """The fewest words that a set of n words shares with any set like it."""
        return -(-self.num * n // self.den)

    def probe(self, n: np.ndarray) -> np.ndarray:
        """Prefix length of a set against sets of its size or smaller."""
        return n + (-self.num * n // self.den) + 1

    def index(self, n: np.ndarray) -> np.ndarray:
        """Prefix length of a set against sets of its size or larger."""
        return n + (-2 * self.num * n // (self.num + self.den)) + 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h


def word_sets(rows: DataFrame, row_id: str, text: str, min_words: int = 5, keep: str | None = None) -> DataFrame:
    """(row_id, words): the 64-bit hashes of each row's different words; shorter and null texts are left out.

    keep: a string column that is passed on, as first column.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids, offsets, flat, kept = [], [0], [], []
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                found = words(t)
                if len(found) >= min_words:
                    kept.append(k)
                    ids.append(i)
                    flat.extend([hashes[w] for w in set(found)])
                    offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            out = {"row_id": pa.array(ids, pa.int64()), "words": lists}
            if keep:
                out = {keep: batch.column(2).take(pa.array(kept, pa.int64()))} | out
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    source = rows.where(F.col(text).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"), *([keep] if keep else []))
    return source.mapInArrow(read, (f"{keep} string, " if keep else "") + "row_id long, words array<long>")


def word_counts(sets: DataFrame) -> DataFrame:
    """(word, n): document frequencies of all words by hash, and the number of rows as that of null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = {}, 0
        for batch in batches:
            n += batch.num_rows
            values, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist()):
                seen[v] = seen.get(v, 0) + c
            if len(seen) > 2_000_000:
                yield _counts(seen, 0)
                seen = {}
        yield _counts(seen, n)

    def _counts(seen: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None, *seen.keys()], pa.int64()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    return sets.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(sets: DataFrame, limit: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes (sorted) and document frequencies of the most frequent words, and the number of rows."""
    top = word_counts(sets).orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(limit + 1).toArrow()
    is_total = top.column("word").is_null()
    rows = sum(top.filter(is_total).column("n").to_pylist())
    top = top.filter(pc.invert(is_total))
    word, n = (top.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    order = np.argsort(word)
    return word[order], n[order], rows


class Coder:
    """Words as codes that sort rarest first: frequent ones by rank, all others negative, by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rows: int) -> None:
        order = np.lexsort((hashes, counts))
        self.hashes, self.rows = hashes, max(rows, 1)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.counts = counts[order]  # by rank
        #: With all words among the frequent ones, any other is in one row only.
        self.complete = len(hashes) < TOP_WORDS

    def encode(self, flat: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return flat | _SIGN
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        return np.where(self.hashes[at] == flat, self.rank[at], flat | _SIGN)

    def share(self, codes: np.ndarray) -> np.ndarray:
        """Estimated share of rows that hold a word."""
        least = self.counts[0] if len(self.counts) else 1
        out = np.full(len(codes), least, np.float64)
        known = codes >= 0
        out[known] = self.counts[codes[known]]
        return out / self.rows


def _mix(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = (key ^ codes.view(np.uint64)) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _expand(rec: np.ndarray, key: np.ndarray, pos: np.ndarray, end: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row once for every later position before `end` of its record: parent row, key, position."""
    count = np.maximum(end[rec] - pos - 1, 0)
    parent = np.repeat(np.arange(len(rec)), count)
    first = np.cumsum(count) - count
    new = pos[parent] + 1 + (np.arange(len(parent)) - first[parent])
    return parent, _mix(key[parent], codes[starts[rec[parent]] + new]), new


def group_rows(starts: np.ndarray, lens: np.ndarray, codes: np.ndarray, coder: Coder, like: Likeness, most: int | None = None, classes: int = 1) -> tuple[np.ndarray, ...]:
    """(record, key, position, depth): the groups in which each record must meet its partners.

    Groups estimated above most (MAX_TASK_ROWS if none is given) rows are replaced by groups of one more word, but
    a record that may share no more words with a partner than the group has stays in the group too. The second word is of
    the first one's class; the words of groups of two and more are then among the first depth + classes - 1 shared, not the first depth.
    """
    most = MAX_TASK_ROWS if most is None else most
    slack = classes - 1
    probe, least = like.probe(lens), like.least_shared(lens)
    reach = probe
    if slack and len(lens):  # the first shared word is of many rows, and with it all others, only where the last word of the prefix is
        reach = np.where(coder.share(codes[starts + probe - 1]) * coder.rows > most, np.minimum(probe + slack, lens), probe)
    rec = np.repeat(np.arange(len(lens)), reach)
    first = np.cumsum(reach) - reach
    pos = np.arange(len(rec)) - first[rec]
    code = codes[starts[rec] + pos]
    if coder.complete:  # a word of one row has no partner
        shared = code >= np.searchsorted(coder.counts, 2)
        rec, pos, code = rec[shared], pos[shared], code[shared]
    key = _mix(np.zeros(len(rec), np.uint64), code)
    big = code >= np.searchsorted(coder.counts, most, "right")
    if not big.any():
        if not slack:
            return rec, key, pos, np.ones(len(rec), np.int64)
        prefix = pos < probe[rec]
        return rec[prefix], key[prefix], pos[prefix], np.ones(int(prefix.sum()), np.int64)
    est = coder.share(code)
    out = []
    for depth in range(1, MAX_DEPTH + 1):
        big = (est * coder.rows > most) if depth < MAX_DEPTH else np.zeros(len(rec), bool)
        here = ~big | (least[rec] <= depth + slack)
        if depth == 1 and slack:
            here &= pos < probe[rec]
        out.append((rec[here], key[here], pos[here], np.full(int(here.sum()), depth)))
        if not big.any():
            break
        r, k, e, before = rec[big], key[big], est[big], pos[big]
        parent, key, pos = _expand(r, k, before, np.minimum(probe + depth + slack, lens), starts, codes)
        rec = r[parent]
        code = codes[starts[rec] + pos]
        est = e[parent] * coder.share(code)
        if depth == 1 and slack:
            same = codes[starts[rec] + before[parent]] % classes == code % classes
            rec, key, pos, est = rec[same], key[same], pos[same], est[same]
    return tuple(np.concatenate(x) for x in zip(*out))


def _row_order(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The order that sorts codes within each row: one sort by row number and the codes' leading bits."""
    owner = np.repeat(np.arange(len(lens), dtype=np.uint64), lens)
    if len(lens) >= 1 << 15:
        return np.lexsort((codes, owner))
    lead = np.where(codes >= 0, codes.view(np.uint64) | np.uint64(1 << 47), (codes.view(np.uint64) & np.uint64(2**63 - 1)) >> np.uint64(16))
    return np.argsort(owner << np.uint64(48) | lead, kind="stable")


def _pack(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> bytes:
    """Columns of a block: frequent words in two bytes, apart by plane; zero stands for a word listed after them."""
    common = np.where(codes >= 0, codes + 1, 0).astype("<u2")
    planes = np.ascontiguousarray(common.view(np.uint8).reshape(-1, 2).T)
    rare = codes[codes < 0]
    raw = np.array([len(ids), len(codes)], "<i8").tobytes() + ids.astype("<i8").tobytes() + rare.astype("<i8").tobytes() + lens.astype("<i4").tobytes() + planes.tobytes()
    return np.array([len(rare)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_rare = int(np.frombuffer(block, "<i8", 1)[0])
    raw = zstandard.ZstdDecompressor().decompress(memoryview(block)[8:])
    n, n_codes = np.frombuffer(raw, "<i8", 2).tolist()
    ids = np.frombuffer(raw, "<i8", n, 16)
    rare = np.frombuffer(raw, "<i8", n_rare, 16 + 8 * n)
    at = 16 + 8 * (n + n_rare)
    lens = np.frombuffer(raw, "<i4", n, at).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, 2 * n_codes, at + 4 * n).reshape(2, -1)
    codes = np.ascontiguousarray(planes.T).view("<u2").reshape(-1).astype(np.int64) - 1
    codes[codes < 0] = rare
    return ids, lens, codes


def _gather(starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Flat positions of the codes of some records."""
    n = lens[which]
    first = np.cumsum(n) - n
    return np.repeat(starts[which] - first, n) + np.arange(int(n.sum()))


class _Local:
    """The comparisons of one task."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, codes: np.ndarray, coder: Coder, like: Likeness) -> None:
        self.ids, self.lens, self.codes, self.coder, self.like = ids, lens, codes, coder, like
        self.starts = np.cumsum(lens) - lens
        one = np.uint64(1)
        h = (codes.view(np.uint64) * _MIX[0]) >> np.uint64(52)  # twelve bits: one of 64 places in each of two sketches
        self.bits = [np.bitwise_or.reduceat(one << x, self.starts) for x in (h >> np.uint64(6), h & np.uint64(63))] if len(ids) else []
        self.short = np.where(codes >= 0, codes.view(np.uint64), _RARE_KEY | (codes.view(np.uint64) & (_RARE_KEY - one)))
        self.probe, self.index, self.least = like.probe(lens), like.index(lens), like.least_shared(lens)
        self.label, self.remap = np.arange(len(ids)), np.arange(len(ids))
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def maybe(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are of different labels and may be alike by their sketches."""
        ok = np.flatnonzero(self.label[i] != self.label[j])
        i, j = i[ok], j[ok]
        most = self.like.most_different(self.lens[i] + self.lens[j])
        near = np.bitwise_count(self.bits[0][i] ^ self.bits[0][j]) <= most
        ok, i, j, most = ok[near], i[near], j[near], most[near]
        return ok[np.bitwise_count(self.bits[1][i] ^ self.bits[1][j]) <= most]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare pairs exactly and join those alike."""
        once = np.unique(np.minimum(i, j) * len(self.ids) + np.maximum(i, j))
        i, j = once // len(self.ids), once % len(self.ids)
        for at in range(0, len(i), 1 << 17):
            a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            pair = np.arange(len(a), dtype=np.uint64) << np.uint64(44)
            keys = np.concatenate([np.repeat(pair, self.lens[x]) | self.short[_gather(self.starts, self.lens, x)] for x in (a, b)])
            keys.sort()
            same = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(44)
            inter = np.bincount(same.astype(np.int64), minlength=len(a))
            total = self.lens[a] + self.lens[b]
            good = self.like.holds(inter, total)
            self.join(a[good], b[good], inter[good] / (total - inter)[good])

    def join(self, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> None:
        """Keep the links that join two labels, and give joined labels one label."""
        up: dict[int, int] = {}
        keep = []
        for k, (a, b) in enumerate(zip(self.label[i].tolist(), self.label[j].tolist())):
            while (x := up.get(a, a)) != a:
                a = x
            while (x := up.get(b, b)) != b:
                b = x
            if a != b:
                up[max(a, b)] = min(a, b)
                keep.append(k)
        if not keep:
            return
        self.links.append((i[keep], j[keep], weight[keep]))
        moved = np.array(sorted(up), np.int64)
        for a in moved.tolist():  # ascending, so what a points to is final
            up[a] = up.get(up[a], up[a])
        self.remap[moved] = [up[a] for a in moved.tolist()]
        self.label = self.remap[self.label]
        self.remap[moved] = moved

    def run(self, rec: np.ndarray, key: np.ndarray, pos: np.ndarray, depth: int, slack: int = 0) -> None:
        """All comparisons within the groups of equal key, all at the same depth; slack: shared words that groups may have passed over."""
        if len(rec) < 2:
            return
        if len(rec) > 1 << 20:  # by ranges of the key, to bound memory
            side = key >> np.uint64(63 - depth % 8) & np.uint64(1)
            for s in (0, 1):
                half = side == s
                if half.all():
                    break
                self.run(rec[half], key[half], pos[half], depth, slack)
            else:
                return
        order = np.sort((key >> np.uint64(23) << np.uint64(23)) | np.arange(len(key), dtype=np.uint64)) if len(key) < 1 << 23 else None
        at = (order & np.uint64((1 << 23) - 1)).astype(np.int64) if order is not None else np.argsort(key, kind="stable")
        group_key = (order >> np.uint64(23)) if order is not None else key[at]
        rec, key, pos = rec[at], key[at], pos[at]
        new = np.append(True, group_key[1:] != group_key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rec)))
        many = np.repeat(size > 1, size)
        rec, key, pos, new = rec[many], key[many], pos[many], new[many]
        if not len(rec):
            return
        first, size, group = np.flatnonzero(new), size[size > 1], np.cumsum(new) - 1
        # the star of each group's first record, then groups that are one already are done
        lead = rec[first][group]
        ok = self.maybe(lead, rec)
        if len(ok):
            self.link(lead[ok], rec[ok])
        label = self.label[rec]
        mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
        indexed = np.logical_or.reduceat(pos < self.index[rec] + depth + slack - 1, first)
        live = (mixed & indexed)[group]
        small = live & (size <= SMALL_GROUP)[group]
        self.pairs(rec[small], group[small])
        large = live & ~small
        rec, key, pos, group = rec[large], key[large], pos[large], group[large]
        if not len(rec):
            return
        self.without_more(rec, group, depth + slack)
        end = np.minimum(self.probe + depth + slack, self.lens)
        step = 1 << 16
        cuts = [0]
        while cuts[-1] < len(rec):  # whole groups together
            k = min(cuts[-1] + step, len(rec))
            if k < len(rec):
                k = int(np.searchsorted(group, group[k - 1], "right"))
            cuts.append(k)
        for a, b in zip(cuts, cuts[1:]):
            r = rec[a:b]
            label = self.label[r]
            parent, k2, p2 = _expand(r, key[a:b], pos[a:b], end, self.starts, self.codes)
            if depth >= MAX_DEPTH or not len(parent):
                self.blocks(r, group[a:b])
                continue
            self.run(r[parent], k2, p2, depth + 1, slack)

    def pairs(self, rec: np.ndarray, group: np.ndarray) -> None:
        """All pairs of small groups, by shifts of the sorted rows."""
        at = np.arange(len(rec))
        found_i, found_j, n = [], [], 0
        for k in range(1, SMALL_GROUP):
            at = at[at + k < len(rec)]
            at = at[group[at] == group[at + k]]
            if not len(at):
                break
            i, j = rec[at], rec[at + k]
            ok = self.maybe(i, j)
            if len(ok):
                found_i.append(i[ok])
                found_j.append(j[ok])
        if found_i:
            self.link(np.concatenate(found_i), np.concatenate(found_j))

    def without_more(self, rec: np.ndarray, group: np.ndarray, most: int) -> None:
        """Pairs of large groups that share up to most words, so that no further word may bring them together."""
        short = self.least[rec] <= most
        rec, group = rec[short], group[short]
        if len(rec) < 2:
            return
        order = np.lexsort((self.lens[rec], group))
        # where two sets with a word more each are not alike any more, one of a pair has the shared words only
        longer = self.like.holds(np.array(most), np.array(2 * most + 2))
        self.blocks(rec[order], group[order], None if longer else most)

    def blocks(self, rec: np.ndarray, group: np.ndarray, longest: int | None = None) -> None:
        """Groups that more words don't split: each record (of up to longest words) in turn against the later ones of other labels."""
        for g in np.unique(group):
            own = rec[group == g]
            while len(own) > 1 and (longest is None or self.lens[own[0]] <= longest) and (self.label[own] != self.label[own[0]]).any():
                n = max(1, min(len(own) - 1, (1 << 18) // len(own)))  # so many leaders at once
                i, j = np.triu_indices(n, 1, len(own))
                ok = self.maybe(own[i], own[j])
                if len(ok):
                    self.link(own[i[ok]], own[j[ok]])
                own = own[n:]


def local_links(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray, coder: Coder, like: Likeness, part: int = 0, parts: int = 1, most: int | None = None, classes: int = 1) -> tuple[np.ndarray, ...]:
    """Links (id, id, likeness, lead) among records that meet in a group of one partition; lead is the first record of those joined to them there."""
    task = _Local(ids, lens, codes, coder, like)
    if len(ids) > 1:
        found = []
        for at, some in _slices(lens, task.starts, codes, classes):  # most groups are of other partitions
            rec, key, pos, depth = group_rows(*some, coder, like, most, classes)
            mine = (key % np.uint64(parts)).astype(np.int64) == part
            found.append((rec[mine] + at, key[mine], pos[mine], depth[mine]))
        rec, key, pos, depth = (np.concatenate(x) for x in zip(*found))
        del found
        for d in np.unique(depth):
            own = depth == d
            task.run(rec[own], key[own], pos[own], int(d), classes - 1 if d > 1 else 0)
    if not task.links:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.float64), np.array([], np.int64)
    i, j, weight = (np.concatenate(x) for x in zip(*task.links))
    return ids[i], ids[j], weight, ids[task.label[i]]


def _slices(lens: np.ndarray, starts: np.ndarray, codes: np.ndarray, classes: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The first record and (starts, lens, codes) of slices of GROUPED_ROWS records; of all where groups are few."""
    step = GROUPED_ROWS if classes > 1 else max(1, len(lens))
    for at in range(0, len(lens), step):
        own = slice(at, at + step)
        base = starts[at]
        yield at, (starts[own] - base, lens[own], codes[base : starts[own][-1] + lens[own][-1]])


def _coded(lists: pa.ListArray, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of word sets, and their words as codes, each set sorted."""
    lens = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = coder.encode(lists.flatten().to_numpy())
    return lens, flat[_row_order(flat, lens)]


def _send_to(lens: np.ndarray, codes: np.ndarray, coder: Coder, like: Likeness, parts: int, most: int | None, classes: int, wave: int = 0, waves: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(partition, record): the partitions of a wave that each record goes to, in order."""
    out = []
    for at, some in _slices(lens, np.cumsum(lens) - lens, codes, classes):
        rec, key, _, _ = group_rows(*some, coder, like, most, classes)
        part = (key % np.uint64(parts)).astype(np.int64)
        if waves > 1:
            now = part % waves == wave
            rec, part = rec[now], part[now]
        out.append(np.unique(part * len(lens) + rec + at))
    to = np.sort(np.concatenate(out)) if len(out) > 1 else out[0]
    return to // len(lens), to % len(lens)


def _fan_out(sets: DataFrame, shared: Broadcast, like: Likeness, most: int | None) -> tuple[int, float]:
    """The best number of classes, and the partitions that a row then goes to, on average: both from a sample, exact where no word is of many rows."""
    _, counts, rows = shared.value
    prefix = 1 + (like.den - like.num) * (int(counts.sum()) / max(rows, 1)) / like.den
    if counts.max(initial=0) <= (most or MAX_TASK_ROWS):
        return 1, prefix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            if batch.num_rows:
                lens, codes = _coded(batch.column(0), coder)
                got = [len(_send_to(lens, codes, coder, like, 1 << 31, most, c)[0]) for c in CLASSES]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (batch.num_rows, *got)], names=["n", *(f"c{c}" for c in CLASSES)])

    sample = sets.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).select("words")
    n, *got = sample.mapInArrow(count, "n long, " + ", ".join(f"c{c} long" for c in CLASSES)).groupBy().sum().first()
    return min(((g / n, c) for g, c in zip(got, CLASSES)))[::-1] if n else (1, prefix)


def likeness_links(sets: DataFrame, like: Likeness = Likeness(), most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b, likeness, lead) links, a != b, and (row_id, rep) of rows that copy another row of their map task.

    sets: the table made by word_sets. Rows without a partner are in neither frame. most: as in group_rows.
    """
    spark = sets.sparkSession
    hashes, counts, rows = frequent_words(sets)
    shared = spark.sparkContext.broadcast((hashes, counts, rows))
    classes, fan_out = _fan_out(sets, shared, like, most)
    parts = max(MIN_PARTS, int(rows * fan_out / (most or MAX_TASK_ROWS)) + 1)
    waves = math.ceil(fan_out / WAVE_COPIES) if fan_out > MAX_COPIES else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lens, codes = _coded(batch.column(1), coder)
            starts = np.cumsum(lens) - lens
            keep, copy_id, copy_rep = [], [], []
            raw = memoryview(codes.tobytes())
            for k, (i, s, n) in enumerate(zip(ids.tolist(), (starts * 8).tolist(), (lens * 8).tolist())):
                digest = xxhash.xxh3_128_digest(raw[s : s + n])
                rep = seen.setdefault(digest, i)
                if rep == i:
                    keep.append(k)
                else:
                    copy_id.append(i)
                    copy_rep.append(rep)
            if copy_id:
                yield _out([-1], [len(copy_id)], [np.concatenate([np.array(copy_id, "<i8"), np.array(copy_rep, "<i8")]).tobytes()])
            keep = np.array(keep, np.int64)
            held.append((ids[keep], lens[keep], codes[_gather(starts, lens, keep)]))
            size += len(keep)
            if size >= BLOCK_ROWS:
                yield flush(held, coder)
                held, size = [], 0
        if size:
            yield flush(held, coder)

    def flush(held: list, coder: Coder) -> pa.RecordBatch:
        ids, lens, codes = (np.concatenate(x) for x in zip(*held))
        return spread(ids, lens, codes, coder, 0) if waves == 1 else _out([-2], [len(ids)], [_pack(ids, lens, codes)])

    def spread(ids: np.ndarray, lens: np.ndarray, codes: np.ndarray, coder: Coder, wave: int) -> pa.RecordBatch:
        part, rec = _send_to(lens, codes, coder, like, parts, most, classes, wave, waves)
        starts = np.cumsum(lens) - lens
        first = np.flatnonzero(np.diff(part, prepend=-1))
        blocks = [rec[a:b] for a, b in zip(first, np.append(first[1:], len(rec)))]
        return _out(part[first].tolist(), [len(r) for r in blocks], [_pack(ids[r], lens[r], codes[_gather(starts, lens, r)]) for r in blocks])

    def _out(part: list[int], sizes: list[int], blocks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "n", "block"])

    def again(wave: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = Coder(*shared.value)
            for batch in batches:
                for block in batch.column(0):
                    yield spread(*_unpack(block.as_py()), coder, wave)

        return run

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        got = [_unpack(b) for b in table.column("block").to_pylist()]
        ids, lens, codes = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(ids)  # so that groups are led by their smallest ids in every task
        codes, ids, lens = codes[_gather(np.cumsum(lens) - lens, lens, order)], ids[order], lens[order]
        a, b, w, lead = local_links(ids, lens, codes, Coder(*shared.value), like, key[0].as_py(), parts, most, classes)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "likeness": w, "lead": lead})

    schema = "part int, n int, block binary"
    sent = cut(sets.mapInArrow(send, schema), "blocks")
    copies = sent.where("part = -1").mapInArrow(_copies, "row_id long, rep long")
    found = None
    for wave in range(waves):
        now = sent.where("part >= 0") if waves == 1 else cut(sent.where("part = -2").select("block").mapInArrow(again(wave), schema), "wave")
        links = _met(now).groupBy("part", "i", "j").applyInArrow(meet, "a long, b long, likeness double, lead long")
        links = cut(links.where("a <> b"), "links")
        found = links if found is None else found.unionByName(links)
        if waves > 1:
            discard(now)
            del now
            spark.sparkContext._jvm.System.gc()  # else the wave's shuffle files stay until the driver happens to collect its garbage
    return found, copies


def _met(sent: DataFrame) -> DataFrame:
    """(part, i, j, block): the blocks that one task takes; i and j are the two parts of an overfull partition that meet there."""
    over = sent.groupBy("part").agg(F.sum("n").alias("rows")).where(F.col("rows") > OVERFULL * MAX_TASK_ROWS)
    over = cut(over.select("part", F.ceil(F.col("rows") / MAX_TASK_ROWS).cast("int").alias("s")), "overfull")
    none = F.lit(0)
    if not over.limit(1).count():
        return sent.select("part", none.alias("i"), none.alias("j"), "block")
    # blocks are numbered by what is in them, so that a block has one number however often it is read
    placed = lookup_join(sent, over, ["part"], "left")
    placed = placed.withColumn("k", F.when(F.col("s").isNull(), 0).otherwise(F.pmod(F.xxhash64("block"), F.col("s"))).cast("int"))
    others = F.filter(F.sequence(none, F.coalesce("s", F.lit(1)) - 1), lambda t: F.col("s").isNull() | (t != F.col("k")))
    return placed.select("part", "k", "block", F.explode(others).alias("t")).select("part", F.least("k", "t").alias("i"), F.greatest("k", "t").alias("j"), "block")


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block").to_pylist():
            ids = np.frombuffer(block, "<i8")
            half = len(ids) // 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[:half]), pa.array(ids[half:])], names=["row_id", "rep"])
