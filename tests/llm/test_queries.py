import pytest

from opinark.llm import queries


def test_all_pack_sizes_are_packed(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, "a short text"), (2, "one more text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"p{i:03}", 16 + i) for i in range(103)], "pack_name string, capacity_tokens int").write.parquet(f"{tmp_path}/pack_sizes.parquet")
    packs = queries._packs(spark, str(tmp_path))
    assert {r.pack_name for r in packs.select("pack_name").collect()} == {f"p{i:03}" for i in range(103)}


def test_all_split_targets_count(spark, tmp_path):
    spark.createDataFrame([(i, f"I{i}", f"{i + 1}") for i in range(412)], "row_id long, parent_asin string, review_id string").write.parquet(f"{tmp_path}/reviews_cleaning2.parquet")
    spark.createDataFrame([(f"s{i:03}", 1 / 103) for i in range(103)], "split_name string, proportion double").write.parquet(f"{tmp_path}/split_targets.parquet")
    got = queries.p6_splits(spark, str(tmp_path)).select("split").distinct().collect()
    assert {"s100", "s101", "s102"} <= {r.split for r in got}
