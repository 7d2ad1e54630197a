"""Queries of the readers and writers: each writes a table, reads it back, and gives the rows."""

import json

from pyspark.sql import functions as F

from opinark import schemas
from opinark.plans.registry import core
from opinark.runtime import scratch_path, table
from opinark.sources import io

_REVIEW = "review_id, parent_asin, user_id, rating, title, helpful_vote"


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "reviews")


@core.query("a1_json_lines", "SELECT parent_asin, asin, user_id, rating, title, text, review_ms AS timestamp, helpful_vote, verified_purchase FROM reviews")
def a1_json_lines(spark, sf_dir):
    """Gzipped JSON lines by the fixed schema."""
    path = scratch_path(spark, "reviews-json")
    _reviews(spark, sf_dir).withColumnRenamed("review_ms", "timestamp").drop("ingested_at", "review_id").write.option("compression", "gzip").json(path)
    return io.read_reviews(spark, path, spread=8).drop("images")


@core.query("a2_text_from_json", "SELECT parent_asin, title, price, len(features) AS n_features, details FROM item_meta")
def a2_text_from_json(spark, sf_dir):
    path = scratch_path(spark, "meta-json")
    io.write_jsonl(table(spark, sf_dir, "item_meta"), path)
    return io.read_meta(spark, path).select("parent_asin", "title", "price", F.size("features").alias("n_features"), "details")


@core.query("a3_raw_lines", "SELECT parent_asin, store FROM item_meta")
def a3_raw_lines(spark, sf_dir):
    path = scratch_path(spark, "meta-lines")
    io.write_jsonl(table(spark, sf_dir, "item_meta"), path)
    return io.read_json_lines(spark, path).select(F.get_json_object("value", "$.parent_asin").alias("parent_asin"), F.get_json_object("value", "$.store").alias("store"))


_SHEET = "row_id bigint, sentence_text string, rating double"


@core.query("a10_csv", "SELECT row_id, nullif(sentence_text, '') AS sentence_text, rating FROM seed_42")
def a10_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    io.write_csv(table(spark, sf_dir, "seed_42").select("row_id", F.nullif("sentence_text", F.lit("")).alias("sentence_text"), "rating"), path)
    return io.read_labels_csv(spark, path, _SHEET)


@core.query("a11_csv_parts", "SELECT row_id, rating FROM seed_42 WHERE row_id % 3 < 2")
def a11_csv_parts(spark, sf_dir):
    """Two of three named parts are there; the third is warned of and left out."""
    rows = table(spark, sf_dir, "seed_42").select("row_id", "rating")
    parts = [scratch_path(spark, f"csv-part-{k}") for k in range(3)]
    for k in (0, 1):
        io.write_csv(rows.where(F.col("row_id") % 3 == k), parts[k])
    return io.read_labels_csv(spark, io.existing(spark, parts, warn=True), "row_id bigint, rating double")


@core.query("a13_first_lines", "SELECT row_id FROM seed_42 ORDER BY row_id LIMIT 100")
def a13_first_lines(spark, sf_dir):
    """The first lines of one gz file; the limit is the feature."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "seed_42").select("row_id").repartitionByRange(1, "row_id").sortWithinPartitions("row_id").write.option("compression", "gzip").json(path)
    return io.sample_lines(spark, path, 100).select(F.get_json_object("value", "$.row_id").cast("bigint").alias("row_id"))


@core.query("a14_chunks", "SELECT row_id, CAST(row_id % 12 AS BIGINT) AS chunk FROM ate_all WHERE row_id % 12 BETWEEN 2 AND 10")
def a14_chunks(spark, sf_dir):
    """Chunks 2 to 10 of 12: the order of their names is not that of their numbers."""
    path = scratch_path(spark, "chunks")
    table(spark, sf_dir, "ate_all").select("row_id", (F.col("row_id") % 12).alias("chunk")).write.partitionBy("chunk").parquet(path)
    chosen = io.select_chunks(io.list_chunks(spark, path, r"chunk="), first=2, last=10)
    return spark.read.option("basePath", path).schema("row_id bigint, chunk bigint").parquet(*chosen)


@core.query("a15_manifest", "SELECT category_name AS category, 'part-' || n || '.parquet' AS file FROM keep_targets, (VALUES (1), (2)) AS v(n)")
def a15_manifest(spark, sf_dir):
    names = [r["category_name"] for r in table(spark, sf_dir, "keep_targets").collect()]  # the manifest: one entry a category
    path = scratch_path(spark, "manifest")
    text = json.dumps({"train": {c: ["part-1.parquet", "part-2.parquet"] for c in names}, "test": {c: [] for c in names}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return io.read_manifest(spark, path, "train")


@core.query("a16_required_columns", "SELECT 'no_such_column' AS missing UNION ALL SELECT 'nor_this'")
def a16_required_columns(spark, sf_dir):
    """The names in the error of a failed validation."""
    try:
        schemas.validate(_reviews(spark, sf_dir), ["review_id", "no_such_column", "rating", "nor_this"])
    except ValueError as error:
        return spark.createDataFrame([(n,) for n in str(error).partition(": ")[2].split(", ")], "missing string")
    return spark.createDataFrame([], "missing string")


@core.query("b1_overwrite", f"SELECT {_REVIEW} FROM reviews WHERE rating >= 3")
def b1_overwrite(spark, sf_dir):
    path = scratch_path(spark, "overwrite")
    rows = _reviews(spark, sf_dir).selectExpr(*_REVIEW.split(", "))
    io.write_parquet(rows, path)
    io.write_parquet(rows.where("rating >= 3"), path)
    return spark.read.parquet(path)


@core.query("b2_by_key", "SELECT parent_asin, count(*) AS n, CAST(1 AS BIGINT) AS n_files FROM ate_all GROUP BY 1")
def b2_by_key(spark, sf_dir):
    """Rows of one key stand in one file."""
    path = scratch_path(spark, "by-key")
    io.write_parquet(table(spark, sf_dir, "ate_all").select("row_id", "parent_asin"), path, key="parent_asin", partitions=16)
    found = spark.read.parquet(path).withColumn("file", F.input_file_name())
    return found.groupBy("parent_asin").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


@core.query("b3_conformed", "SELECT parent_asin, CAST(sentence_id AS VARCHAR) AS sentence_id, sentence_text, rating, CAST(NULL AS VARCHAR) AS confidence_bucket FROM seed_42")
def b3_conformed(spark, sf_dir):
    """Written by a schema: another type is cast, an absent column is null."""
    path = scratch_path(spark, "conformed")
    io.write_conformed(table(spark, sf_dir, "seed_42").drop("aspects", "confidences"), path, schemas.ATE_ALL)
    return spark.read.parquet(path).select("parent_asin", "sentence_id", "sentence_text", "rating", "confidence_bucket")


@core.query("b4_append", "SELECT row_id, CAST(row_id % 3 AS INTEGER) AS batch FROM seed_42")
def b4_append(spark, sf_dir):
    path = scratch_path(spark, "append")
    rows = table(spark, sf_dir, "seed_42").select("row_id", (F.col("row_id") % 3).cast("int").alias("batch"))
    for k in range(3):
        io.append_parquet(rows.where(F.col("batch") == k), path)
    return spark.read.parquet(path)


@core.query("b5_merge_parts", "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN rating END AS rating FROM seed_42")
def b5_merge_parts(spark, sf_dir):
    """One of two parts lacks a column."""
    rows = table(spark, sf_dir, "seed_42").select("row_id", "rating")
    parts = [scratch_path(spark, f"merge-{k}") for k in (0, 1)]
    io.write_parquet(rows.where("row_id % 2 = 0"), parts[0])
    io.write_parquet(rows.where("row_id % 2 <> 0").drop("rating"), parts[1])
    return io.merge_parts(spark, parts, table(spark, sf_dir, "seed_42").select("row_id", "rating").schema)


@core.query("b7_empty", "SELECT row_id, sentence_text FROM seed_42 WHERE false")
def b7_empty(spark, sf_dir):
    path = scratch_path(spark, "empty")
    io.write_empty(spark, path, table(spark, sf_dir, "seed_42").select("row_id", "sentence_text").schema)
    return spark.read.parquet(path)


@core.query("b8_csv_report", "SELECT trim(upper(parent_asin)) AS item, count(*) AS n FROM reviews WHERE trim(parent_asin) <> '' GROUP BY 1")
def b8_csv_report(spark, sf_dir):
    path = scratch_path(spark, "csv-report")
    io.write_csv(_reviews(spark, sf_dir).where("trim(parent_asin) <> ''").groupBy(F.trim(F.upper("parent_asin")).alias("item")).agg(F.count("*").alias("n")), path, one_file=True)
    return io.read_labels_csv(spark, path, "item string, n bigint")


@core.query("b10_label_lines", "SELECT row_id, aspects, len(confidences) AS n_confidences FROM ate_all")
def b10_label_lines(spark, sf_dir):
    path = scratch_path(spark, "labels")
    io.write_jsonl(table(spark, sf_dir, "ate_all").select("row_id", "aspects", F.size("confidences").alias("n_confidences")), path)
    return spark.read.schema("row_id bigint, aspects array<string>, n_confidences bigint").json(path)


@core.query("b12_compression", "SELECT codec, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids, true AS has_bytes FROM seed_42, (VALUES ('gzip'), ('snappy'), ('zstd')) AS c(codec) GROUP BY 1")
def b12_compression(spark, sf_dir):
    """Each codec gives the rows back; b14: the size of what was written."""
    out = None
    for codec in ("gzip", "snappy", "zstd"):
        path = scratch_path(spark, f"codec-{codec}")
        io.write_parquet(table(spark, sf_dir, "seed_42").select("row_id", "sentence_text"), path, compression=codec)
        one = spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("row_id").alias("ids")).select(F.lit(codec).alias("codec"), "n", "ids", F.lit(io.path_size(spark, path) > 0).alias("has_bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@core.query("g5_surrogate_ids", "SELECT count(*) AS n, count(*) AS n_ids, CAST(1 AS BIGINT) AS least FROM seed_42")
def g5_surrogate_ids(spark, sf_dir):
    numbered = io.surrogate_ids(table(spark, sf_dir, "seed_42").select("row_id"))
    return numbered.agg(F.count("*").alias("n"), F.count_distinct("sid").alias("n_ids"), F.min("sid").alias("least"))
