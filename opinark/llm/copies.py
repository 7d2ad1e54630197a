"""Duplicates hidden by formatting: one record each, with its number of copies (problem 1).

Each text gets canonical keys. The linear key is the sequence of its letters and digits in lower
case, with marks kept only directly between two digits. A text of three or more labelled fields
also gets a field key, in which the order of the fields does not count. Records are the classes of
texts joined by equal keys of either kind.

The ledger is a table of (linear key, field key, copies, earliest row) in hash buckets, kept under a path
from run to run. A batch is aggregated by key first, so a key with a third of all rows costs one row a
task, and then full-outer-joined against the ledger rows of the buckets it touches; counts are added and the
earliest row is kept. Other buckets are left alone. The number of buckets doubles as the ledger grows, so a
bucket stays a task's work. A new version takes effect when its manifest is renamed into place: a run that
breaks off leaves the version before it.

Defined results: null texts and texts under min_words words are in no record; a record seen once
has one copy; rows repeated with the same id count each; an empty batch changes nothing.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark.llm.text import word_count
from opinark.runtime import cut, discard, lookup_join, remove

LEDGER = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("linear_key", T.BinaryType()),
        T.StructField("field_key", T.BinaryType()),
        T.StructField("n_copies", T.LongType()),
        T.StructField("first_row_id", T.LongType()),
    ]
)


def canonical_text(text: Column) -> Column:
    """Letters and digits in lower case and order; a mark directly between two digits stays."""
    return F.regexp_replace(F.lower(text), r"(?<!\p{N})[^\p{L}\p{N}]|[^\p{L}\p{N}](?!\p{N})|[\s\p{Z}]", "")


def canonical_fields(text: Column) -> Column:
    """The sorted canonical fields of a text that is three or more labelled fields, else null."""
    fields = F.filter(F.split(text, "[;|]"), lambda f: F.regexp_like(f, F.lit(r"[^\s\p{Z}]")))
    labelled = (F.size(fields) >= 3) & F.forall(fields, lambda f: F.contains(f, F.lit(":")))
    return F.when(labelled, F.array_join(F.array_sort(F.transform(fields, canonical_text)), "\n"))


def keyed_rows(rows: DataFrame, row_id: str, text: str, min_words: int = 5) -> DataFrame:
    """(row_id, linear_key, field_key) of the rows with a record."""
    t = F.col(text)
    has_cuts = F.contains(t, F.lit(":")) & F.regexp_like(t, F.lit("[;|]"))
    return rows.where(t.isNotNull() & (word_count(t) >= min_words)).select(
        F.col(row_id).cast("long").alias("row_id"),
        F.unhex(F.md5(canonical_text(t))).alias("linear_key"),
        F.when(has_cuts, F.unhex(F.md5(canonical_fields(t)))).alias("field_key"),
    )


def aggregate_batch(keyed: DataFrame, buckets: int) -> DataFrame:
    counted = keyed.groupBy("linear_key", "field_key").agg(F.count("*").alias("n_copies"), F.min("row_id").alias("first_row_id"))
    return in_buckets(counted, buckets)


def in_buckets(counted: DataFrame, buckets: int) -> DataFrame:
    return counted.withColumn("bucket", F.pmod(F.xxhash64("linear_key"), F.lit(buckets)).cast("int")).select(*LEDGER.fieldNames())


def merge_batch(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger's buckets after one more aggregated batch: counts added, the earliest row kept."""
    old, new = ledger.alias("o"), batch.alias("n")
    same = (F.col("o.bucket") == F.col("n.bucket")) & (F.col("o.linear_key") == F.col("n.linear_key")) & F.col("o.field_key").eqNullSafe(F.col("n.field_key"))
    merged = old.join(new, same, "full_outer")
    return merged.select(
        *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("bucket", "linear_key", "field_key")),
        (F.coalesce("o.n_copies", F.lit(0)) + F.coalesce("n.n_copies", F.lit(0))).alias("n_copies"),
        F.least("o.first_row_id", "n.first_row_id").alias("first_row_id"),
    )


class Ledger:
    """The ledger under a path; opened again, it goes on where the last completed run left it.

    A batch reads and rewrites only the buckets that its keys fall into. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = 200_000) -> None:
        self.spark, self.path, self.rows_per_bucket = spark, path.rstrip("/"), rows_per_bucket
        self.version, self.buckets, self.rows = 0, 1, 0
        self.parts: list[tuple[str, set[int]]] = []  # tables and the buckets still valid in them
        self._open()

    def _hadoop(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _open(self) -> None:
        fs, at = self._hadoop("manifests")
        if not fs.exists(at):
            return
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        if not (done := sorted(n for n in names if n.endswith(".json"))):
            return
        fs, at = self._hadoop(f"manifests/{done[-1]}")
        found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(at), "UTF-8"))
        self.version, self.buckets, self.rows = found["version"], found["buckets"], found["rows"]
        self.parts = [(p["table"], set(p["buckets"])) for p in found["parts"]]

    def _commit(self, parts: list[tuple[str, set[int]]], buckets: int) -> None:
        """Write the manifest of the next version under a passing name, rename it, and drop tables no longer named."""
        before = {t for t, _ in self.parts}
        self.parts, self.buckets, self.version = parts, buckets, self.version + 1
        self.rows = self.table.count()
        text = json.dumps({"version": self.version, "buckets": self.buckets, "rows": self.rows, "parts": [{"table": t, "buckets": sorted(b)} for t, b in parts]})
        fs, passing = self._hadoop(f"manifests/{self.version:012}.{uuid.uuid4().hex[:8]}")
        out = fs.create(passing)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = self._hadoop(f"manifests/{self.version:012}.json")
        if not fs.rename(passing, final):
            raise RuntimeError(f"{final} is there already: two runs write one ledger")
        for t in before - {t for t, _ in parts}:
            remove(self.spark, f"{self.path}/{t}")

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{self.version + 1:012}-{uuid.uuid4().hex[:8]}"
        rows.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _read(self, buckets: set[int]) -> DataFrame | None:
        out = None
        for name, valid in self.parts:
            if wanted := sorted(valid & buckets):
                part = self.spark.read.schema(LEDGER).parquet(f"{self.path}/{name}").select(*LEDGER.fieldNames())
                if len(wanted) < self.buckets:
                    part = part.where(F.col("bucket").isin(wanted))
                out = part if out is None else out.unionByName(part)
        return out

    def add(self, rows: DataFrame, row_id: str, text: str, min_words: int = 5) -> None:
        self.add_keyed(keyed_rows(rows, row_id, text, min_words))

    def add_keyed(self, keyed: DataFrame) -> None:
        batch = cut(aggregate_batch(keyed, self.buckets), "batch")
        n = batch.count()
        if not n:
            return
        buckets = self.buckets
        while self.rows + n > buckets * self.rows_per_bucket:
            buckets *= 2
        if buckets > self.buckets:  # all keys get their new buckets
            old = self._read(set(range(self.buckets)))
            merged = in_buckets(merge_batch(old, batch) if old is not None else batch, buckets)
            self._commit([(self._write(merged), set(range(buckets)))], buckets)
        else:
            touched = {r["bucket"] for r in batch.select("bucket").distinct().toLocalIterator()}  # at most `buckets` numbers
            old = self._read(touched)
            name = self._write(merge_batch(old, batch) if old is not None else batch)
            self._commit([*((t, valid - touched) for t, valid in self.parts if valid - touched), (name, touched)], buckets)
        discard(batch)

    @property
    def table(self) -> DataFrame:
        out = self._read(set(range(self.buckets)))
        return out if out is not None else self.spark.createDataFrame([], LEDGER)

    def records(self) -> DataFrame:
        """Ledger rows with record_key: the key that all texts of one record share."""
        return resolve(self.table)


def resolve(ledger: DataFrame) -> DataFrame:
    """Add record_key. Only texts with a field key can join several keys, so only these iterate."""
    fielded = ledger.where("field_key is not null").select("linear_key", "field_key").distinct()
    links = cut(fielded.withColumn("label", F.col("field_key")), "alias")
    while True:
        by_linear = links.groupBy("linear_key").agg(F.min("label").alias("low"))
        step = links.join(by_linear, "linear_key")
        by_field = step.groupBy("field_key").agg(F.min("low").alias("lowest"))
        new = cut(step.join(by_field, "field_key").select("linear_key", "field_key", F.col("lowest").alias("label"), (F.col("lowest") != F.col("label")).alias("moved")), "alias")
        moved = new.where("moved").limit(1).count()
        discard(links)
        links = new.drop("moved")
        if not moved:
            break
    alias = links.groupBy("linear_key").agg(F.min("label").alias("label"))
    return ledger.join(alias, "linear_key", "left").withColumn("record_key", F.coalesce("label", "linear_key")).drop("label")


def records(ledger: DataFrame) -> DataFrame:
    """(record_key, n_copies, first_row_id): one row per record."""
    return ledger.groupBy("record_key").agg(F.sum("n_copies").alias("n_copies"), F.min("first_row_id").alias("first_row_id"))


#: Keys of more copies, or of a larger share of all rows, meet their rows without a shuffle.
HOT_COPIES, HOT_SHARE = 100_000, 1 / 50_000


def memberships(keyed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(first_row_id, row_id) for each keyed row.

    Keys seen once need no join: a row whose key has one copy, in a record of one copy, is its
    own first row. So only repeated keys meet the rows. Hot keys, 1 / HOT_SHARE at most, are broadcast; their
    rows stay where they are, all others are shuffled by key.
    """
    total = resolved.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    hot = F.col("n_copies") > max(HOT_COPIES, math.ceil(total * HOT_SHARE))
    firsts = records(resolved).where("n_copies > 1").select("record_key", F.col("first_row_id").alias("record_first"))
    repeated = cut(resolved.join(firsts, "record_key").select("linear_key", F.coalesce("field_key", F.unhex(F.lit(""))).alias("fk"), "n_copies", "record_first"), "repeated")
    rows = keyed.select("row_id", "linear_key", F.coalesce("field_key", F.unhex(F.lit(""))).alias("fk"))
    hot_keys = repeated.where(hot)
    at_hot = None
    if hot_keys.limit(1).count():
        marked = lookup_join(rows, hot_keys.select("linear_key", "fk", F.col("record_first").alias("hot_first")), ["linear_key", "fk"], "left")
        at_hot = marked.where("hot_first is not null").select(F.col("hot_first").alias("first_row_id"), "row_id")
        rows = marked.where("hot_first is null").drop("hot_first")
    joined = rows.join(repeated.where(~hot).drop("n_copies"), ["linear_key", "fk"]).select(F.col("record_first").alias("first_row_id"), "row_id")
    return joined if at_hot is None else joined.unionByName(at_hot)
