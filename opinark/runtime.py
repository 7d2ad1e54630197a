"""Session facts that operators need: the shared folder, lineage cuts and size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows, counted before the join.
BROADCAST_ROWS = 100_000

_own_dir: str | None = None
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or a local one where that is unset."""
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="opinark-")
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one table in the shared folder, removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/opinark-{app}"
        atexit.register(remove, spark, _scratch[app])
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more; a failure to delete is not an error."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._opinark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame made by cut()."""
    path = getattr(df, "_opinark_path", None)
    if path:
        remove(df.sparkSession, path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with broadcast only if small was counted and is small; else a plain (shuffled) join."""
    return big.join(F.broadcast(small) if is_small(small) else small, list(on), how)


#: Rows of one key in the large side of a join beyond which they stay where they are.
HOT_ROWS = 100_000


def hot_join(big: DataFrame, small: DataFrame, key: str, n: str, most: int | None = None) -> DataFrame:
    """Inner join of big with small, which has one row a key and in n how many rows of big have the key; n is dropped.

    Rows of hot keys meet a broadcast of these keys, of which there are at most rows / HOT_ROWS (counted all the same);
    all others are shuffled. most: the greatest n, if it is known.
    """
    plain = small.drop(n)
    if most is None:
        most = small.agg(F.max(n)).first()[0]
    if not most or most <= HOT_ROWS:
        return big.join(plain, key)
    columns = [c for c in plain.columns if c != key]
    hot = small.where(F.col(n) > HOT_ROWS).select(key, F.struct(*columns).alias("_hot"))
    marked = lookup_join(big, hot, [key], "left")
    here = marked.where("_hot is not null").select(*big.columns, *(F.col(f"_hot.{c}").alias(c) for c in columns))
    rest = marked.where("_hot is null").drop("_hot").join(small.where(F.col(n) <= HOT_ROWS).drop(n), key)
    return here.unionByName(rest)


#: White space that may stand around names and keys.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"


def strip(c: Column | str) -> Column:
    """c without white space of any kind at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def name_key(c: Column | str) -> Column:
    """Category names compared trimmed, in lower case, with space, hyphen and underscore alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(strip(c)), " -", "__")


def item_key(c: Column | str) -> Column:
    """Item keys compared trimmed and in upper case; blank keys are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(strip(c)), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
