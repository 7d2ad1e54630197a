"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinark import schemas


def read_reviews(spark: SparkSession, path: str | Sequence[str], spread: int | None = None) -> DataFrame:
    """JSON lines, plain or gz, by the fixed schema. A gz file is one task: spread repartitions after it."""
    df = spark.read.schema(schemas.REVIEWS).json(path)
    return df.repartition(spread) if spread else df


def read_meta(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines as text, parsed by the fixed schema; details stay raw JSON; bad lines are null rows."""
    return spark.read.text(path).select(F.from_json("value", schemas.META).alias("data")).select("data.*")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines as (value), for field profiles."""
    return spark.read.text(path)


def read_labels_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; quoted values may hold line ends and doubled quotes. Several files are one table."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(paths)


def existing(spark: SparkSession, paths: Sequence[str], warn: bool = False) -> list[str]:
    """Those of the paths that exist, in order; with warn the others are named in a warning."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            out.append(p)
    if warn and len(out) < len(paths):
        warnings.warn(f"missing: {', '.join(p for p in paths if p not in out)}", stacklevel=2)
    return out


def list_chunks(spark: SparkSession, directory: str, pattern: str = r".*\.parquet$") -> list[str]:
    """Files of a folder whose names match, in natural order of the numbers in them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(directory)
    names = [s.getPath().toString() for s in at.getFileSystem(conf).listStatus(at)]
    return sorted((n for n in names if re.match(pattern, n.rsplit("/", 1)[-1])), key=natural_key)


def natural_key(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name) if p]


def select_chunks(chunks: Sequence[str], first: int | None = None, last: int | None = None, most: int | None = None) -> list[str]:
    """Chunks whose number (the last in the name) lies in first..last, `most` of them at most."""
    def number(name: str) -> int | None:
        found = re.findall(r"\d+", name.rsplit("/", 1)[-1])
        return int(found[-1]) if found else None

    out = [c for c in chunks if (n := number(c)) is not None and (first is None or n >= first) and (last is None or n <= last)]
    return out[:most]


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(category, file) of one split of a JSON manifest {split: {category: [files]}}."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    return parsed.select(F.explode(F.col("m")[split]).alias("category", "files")).select("category", F.explode("files").alias("file"))


def hash_split(df: DataFrame, key: str, n: int, into: str = "split_no") -> DataFrame:
    """A split number 0..n-1 by key hash, in place of a manifest."""
    return df.withColumn(into, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def sample_lines(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    return spark.read.text(path).limit(n)


def write_parquet(df: DataFrame, path: str, key: str | None = None, partitions: int | None = None, by: Sequence[str] = (), compression: str = "snappy") -> None:
    """Overwrite a parquet table; with key rows of one key share a file and the number of files is bounded by 256."""
    if key:
        df = df.repartition(max(1, min(partitions or df.sparkSession.sparkContext.defaultParallelism, 256)), key)
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Add a batch; its columns must be those of the table, as the first batch gave them."""
    df.write.mode("append").parquet(path)


def write_conformed(df: DataFrame, path: str, schema: T.StructType, **options) -> None:
    """By the schema: absent columns null, others left out. Spark's commit makes the table appear whole or not at all."""
    write_parquet(schemas.conform(df, schema), path, **options)


def write_empty(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def merge_parts(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Parts of one schema as one table; columns that a part lacks are null."""
    return spark.read.schema(schema).parquet(*paths)


def pending(df: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among those done: resume without doing work twice."""
    return df if done is None else df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_missing(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header; white space at the ends of texts stays. one_file is for reports only."""
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def slices(df: DataFrame, order: Sequence[str], size: int = 100, into: str = "slice_no") -> DataFrame:
    """Numbers of consecutive slices of `size` rows by order, for sheets that people label.

    Ranks are offsets of range partitions plus ranks inside them; rows are not moved to one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from opinark.runtime import cut

    ranged = cut(ranged, "slices")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    from pyspark.sql import Window

    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(before.select("_p", "_first", "_before")), "_p")
    return placed.withColumn(into, F.expr(f"(_before + _m - _first) div {size}")).drop("_p", "_m", "_first", "_before")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_lines(stats: DataFrame, title: str) -> DataFrame:
    """A one-row statistics frame as (line) text, first the title."""
    pairs = stats.select(F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats.columns))).alias("line"))
    return stats.sparkSession.createDataFrame([(title,)], "line string").unionByName(pairs)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def surrogate_ids(df: DataFrame, into: str = "sid") -> DataFrame:
    """Unique numbers from 1, ascending with gaps. They follow the layout; for lasting ids hash a key."""
    return df.withColumn(into, F.monotonically_increasing_id() + 1)


def human_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"


def map_batches(df: DataFrame, score: Callable, schema: str, order: str | None = None) -> DataFrame:
    """A Python scorer over Arrow batches; with order, rows of like size come together so that padding is small."""
    source = df.sortWithinPartitions(order) if order else df
    return source.mapInPandas(lambda batches: (score(b) for b in batches), schema)
