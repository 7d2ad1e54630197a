import pytest

from opinark.llm import copies
from opinark.runtime import scratch_path

ROWS = [
    (1, "The screen is very bright, and big!"),
    (2, "the  SCREEN is very-bright and big"),
    (3, "pros: good light; cons: bad sound; verdict: keep it"),
    (4, "Cons: bad sound | verdict : keep it | PROS: good light"),
    (5, "pros good light cons bad sound verdict keep it"),
    (6, None),
    (7, ""),
    (8, "too short"),
    (9, "It took 3.3 hours to charge it"),
    (10, "It took 33 hours to charge it"),
    (11, "It took 3.3 hours to charge it"),
    (11, "It took 3.3 hours to charge it"),
]
PAIRS = {(1, 2), (3, 4), (3, 5), (9, 11)}


def found(spark, batches, extra=False):
    frames = [spark.createDataFrame(b, "row_id long, sentence_text string") for b in batches]
    if extra:
        frames = [f.selectExpr("*", "1 AS bucket", "'x' AS linear_key", "2 AS n_copies") for f in frames]
    path = scratch_path(spark, "ledger")
    for f in frames:
        copies.Ledger(spark, path, rows_per_bucket=2).add(f, "row_id", "sentence_text")
    keyed = copies.keyed_rows(frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1]), "row_id", "sentence_text")
    resolved = copies.Ledger(spark, path).records()
    pairs = {(r.first_row_id, r.row_id) for r in copies.memberships(keyed, resolved).where("row_id <> first_row_id").collect()}
    counts = {r.first_row_id: r.n_copies for r in copies.records(resolved).collect()}
    return pairs, counts


def test_formats_fields_and_numbers(spark):
    pairs, counts = found(spark, [ROWS])
    assert pairs == PAIRS
    assert counts == {1: 2, 3: 3, 9: 3, 10: 1}


def test_batches_give_the_same_ledger(spark):
    whole = found(spark, [ROWS])
    assert found(spark, [ROWS[6:], ROWS[:6]]) == whole
    assert found(spark, [ROWS, []])[1] == whole[1]


def test_extra_columns_with_clashing_names(spark):
    assert found(spark, [ROWS], extra=True)[0] == PAIRS


def test_empty_table(spark):
    assert found(spark, [[]]) == (set(), {})


def test_very_long_text(spark):
    long = "word " * 200_000
    assert found(spark, [[(1, long), (2, long.upper())]])[0] == {(1, 2)}


def test_labelled_fields_on_lines_of_their_own(spark):
    """No single line holds both a colon and a separator."""
    rows = [(1, "Color:\nred;\nSize:\nlarge;\nFit:\nslim"), (2, "Fit:\nslim;\nColor:\nred;\nSize:\nlarge"), (3, "size: large | color: red | fit: slim")]
    assert found(spark, [rows]) == ({(1, 2), (1, 3)}, {1: 3})


def test_ledger_is_kept_from_run_to_run_and_grows(spark):
    """add, open again, add: old copies are counted on, the earliest row stays, buckets double, a broken run leaves no mark."""
    path = scratch_path(spark, "ledger")
    texts = [f"record number {i} has enough words" for i in range(40)]
    frame = lambda ids: spark.createDataFrame([(i, texts[i % 40]) for i in ids], "row_id long, sentence_text string")
    copies.Ledger(spark, path, rows_per_bucket=10).add(frame(range(10, 14)), "row_id", "sentence_text")
    first = copies.Ledger(spark, path, rows_per_bucket=10)
    assert (first.version, first.buckets, first.rows) == (1, 1, 4)
    second = copies.Ledger(spark, path, rows_per_bucket=10)
    second.add(frame([*range(40), 51]), "row_id", "sentence_text")
    again = copies.Ledger(spark, path, rows_per_bucket=10)
    assert (again.version, again.buckets, again.rows) == (2, 8, 40)
    got = {r.first_row_id: r.n_copies for r in again.table.collect()}
    assert got == {i: 3 if i == 11 else 2 if i in (10, 12, 13) else 1 for i in range(40)}

    def broken(parts, buckets):
        raise OSError("lost")

    again._commit = broken
    with pytest.raises(OSError):
        again.add(frame([7]), "row_id", "sentence_text")
    last = copies.Ledger(spark, path, rows_per_bucket=10)
    last.add(frame([47]), "row_id", "sentence_text")
    got = {r.first_row_id: r.n_copies for r in copies.Ledger(spark, path).table.collect()}
    assert got[7] == 2 and sum(got.values()) == 46 and last.version == 3
    # a batch leaves buckets alone that it has no keys of
    assert len(last.parts) == 2


def test_hot_key_and_equal_share_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT_COPIES", 5)
    rows = [(i, "one record that a third of all rows hold") for i in range(30)] + [(100 + i, f"record number {i // 2} has enough words") for i in range(60)]
    pairs, counts = found(spark, [rows])
    assert pairs == {(0, i) for i in range(1, 30)} | {(100 + i - 1, 100 + i) for i in range(1, 60, 2)}
    assert counts[0] == 30 and len(counts) == 31
