"""Queries on fields that hold several values (problem 2)."""

from pyspark.sql import functions as F

from opinark.operators.packed import split_packed
from opinark.plans.registry import core
from opinark.runtime import table


@core.query("p2_found")
def p2_found(spark, sf_dir):
    rows = table(spark, sf_dir, "seed_42").select("row_id", "aspects", "confidences")
    return split_packed(rows, "row_id", ("aspects", "confidences"), (False, True))


@core.query("p2_value_counts")
def p2_value_counts(spark, sf_dir):
    """How often each aspect occurs, in how many rows, and its mean position."""
    found = p2_found(spark, sf_dir).where("field_name = 'aspects'")
    return found.groupBy("item_value").agg(
        F.count("*").alias("n_places"), F.count_distinct("row_id").alias("n_rows"), F.round(F.avg("pos"), 6).alias("mean_pos")
    )
