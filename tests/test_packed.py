import pytest

from opinark.operators import packed


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "row_id long, aspects string, confidences string").selectExpr("*", "1 AS k", "2 AS hyps", "3 AS pos", "4 AS item_value")
    out = packed.split_packed(df, "row_id", ("aspects", "confidences"), (False, True), **options)
    got = {}
    for r in sorted(out.collect()):
        got.setdefault((r.row_id, r.field_name[0]), []).append((r.pos, r.item_value))
    return got


FIELDS = [
    ("['a', 'b']", "[0.5 0.25]", ["a", "b"], ["0.5000", "0.2500"]),
    ("['a'  'b'\n 'c']", "0,5; 0,25; nan", ["a", "b", "c"], ["0.5000", "0.2500", "nan"]),
    ('["so-called ""pro"" mode", "x"]', '"0.5","0.6"', ['so-called "pro" mode', "x"], ["0.5000", "0.6000"]),
    ("['kids\\' mode', \"rock 'n' roll\"]", "0.1\t0.2", ["kids' mode", "rock 'n' roll"], ["0.1000", "0.2000"]),
    ("kids' mode / reader's notes", "0.1|0.2", ["kids' mode", "reader's notes"], ["0.1000", "0.2000"]),
    ('"yes|no prompt"| size | "a; b"', "0.1 | 0.2 | 0.3", ["yes|no prompt", "size", "a; b"], ["0.1000", "0.2000", "0.3000"]),
    ("[beta] menu; x", "0.1; 0.2", ["[beta] menu", "x"], ["0.1000", "0.2000"]),
    ("['[beta] menu', 'x']", "[nan, 1]", ["[beta] menu", "x"], ["nan", "1.0000"]),
    ("plain value", "0,5", ["plain value"], ["0.5000"]),
    ("on/off switch", "0.5", ["on/off switch"], ["0.5000"]),
    ("[]", "[]", [], []),
    ("", None, [], []),
    ("  ", "[ ]", [], []),
]


def test_notations(spark):
    got = run(spark, [(i, a, c) for i, (a, c, _, _) in enumerate(FIELDS)])
    for i, (_, _, want_a, want_c) in enumerate(FIELDS):
        assert [v for _, v in got.get((i, "a"), [])] == want_a, FIELDS[i]
        assert [v for _, v in got.get((i, "c"), [])] == want_c, FIELDS[i]


def test_empty_places_keep_positions(spark):
    got = run(spark, [(1, 'a; ; "c"', "0.1||0.3"), (2, "a\t\tc", "0.1; ; 0.3")])
    for i in (1, 2):
        assert got[i, "a"] == [(1, "a"), (3, "c")] and got[i, "c"] == [(1, "0.1000"), (3, "0.3000")]


def test_the_column_teaches_how_to_split(spark):
    """Without a parallel field, frequent values decide: the slash divides one field and belongs to a value of another."""
    rows = [(i, "['battery', 'on/off switch', 'handle']", "[0.1, 0.2, 0.3]") for i in range(50)] + [(90, "battery / handle", None), (91, "on/off switch", None)]
    got = run(spark, rows)
    assert [v for _, v in got[90, "a"]] == ["battery", "handle"] and [v for _, v in got[91, "a"]] == ["on/off switch"]


def test_repeats_long_fields_and_empty_table(spark):
    long = "|".join(["v"] * 5000)
    got = run(spark, [(1, long, "|".join(["0.5"] * 5000)), (2, "x|x", "0.1|0.1")])
    assert len(got[1, "a"]) == 5000 and got[1, "c"][-1] == (5000, "0.5000")
    assert got[2, "a"] == [(1, "x"), (2, "x")]
    assert run(spark, []) == {}


def test_every_row_is_independent_of_layout(spark):
    rows = [(i, a, c) for i, (a, c, _, _) in enumerate(FIELDS * 5)]
    assert run(spark, rows) == run(spark, rows[::-1])


@pytest.mark.parametrize("text, want", [("0.12345", "0.1234"), ("1e-1", "0.1000"), ("-0,5", "-0.5000"), ("NaN", "nan"), ("x", None), ("", "")])
def test_numbers(text, want):
    assert packed.number_text(text) == want


def test_places_of_the_parallel_field_decide_with_any_number_of_ways(spark):
    """12 pieces for 6 places can be joined in 462 ways: the values of the column decide, and quoted pieces stay apart."""
    words = "ab cd ef gh ij kl".split()
    rows = [(i, f"{a}/{b}|{c}", "0.1|0.2") for i, (a, b, c) in enumerate((a, b, c) for a in words for b in words for c in words if a != b)]
    rows += [(900, "/".join(f"{w}/x{w}" for w in words), "0.1|0.2|0.3|0.4|0.5|0.6")]
    rows += [(i, f"'{w}/x{w}'", "0.5") for i, w in enumerate(words * 20, 1000)]
    got = run(spark, rows)
    assert [v for _, v in got[900, "a"]] == [f"{w}/x{w}" for w in words]
    assert [v for _, v in got[0, "a"]] == ["ab/cd", "ab"]


def test_decimal_commas_between_separating_commas(spark):
    got = run(spark, [(1, "a|b|c", "0,85,0,62,nan"), (2, '"a, b",c,d', "0.1|0.2")])
    assert [v for _, v in got[1, "c"]] == ["0.8500", "0.6200", "nan"]
    assert [v for _, v in got[2, "a"]] == ["a, b", "c,d"]


def brute(both, allowed, rates):
    """Every path of a row with its weight."""
    import math

    def of(chains, f):
        out = []
        for chain in chains:
            ways = [((), 0, 0.0)]
            while ways:
                way, at, w = ways.pop()
                if at == chain.nodes:
                    out.append((way, w))
                ways.extend(((*way, v), b, w + rates[f](v)) for a, b, v in chain.edges if a == at)
        return out or [((), 0.0)]

    pairs = [((x, y), math.exp(u + w)) for x, u in of(both[0], 0) for y, w in of(both[1], 1) if allowed is None or (len(x) == len(y) and len(x) in allowed)]
    return pairs


def test_forward_backward_and_viterbi_against_all_paths():
    import math
    import random

    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("ab,;|/ '") for _ in range(rng.randrange(1, 10)))
        b = "".join(rng.choice("01,;. ") for _ in range(rng.randrange(1, 8)))
        *both, allowed = packed.row_lattices(a, b, (False, True), True)
        table = {}
        rates = tuple(lambda v, f=f: table.setdefault((f, v), -rng.random() * 5) for f in (0, 1))
        pairs = brute(both, allowed, rates)
        total = sum(w for _, w in pairs)
        want = {}
        for (x, y), w in pairs:
            for f, way in enumerate((x, y)):
                for v in way:
                    want[f, v] = want.get((f, v), 0.0) + w / total
        got = {}
        for f, v, p in packed.expected(tuple(both), allowed, rates):
            got[f, v] = got.get((f, v), 0.0) + p
        assert all(math.isclose(got.get(k, 0.0), w, abs_tol=1e-6) for k, w in want.items())
        best = packed.viterbi(tuple(both), allowed, rates)
        weight = sum(rates[f](v) for f, way in enumerate(best) for v in way)
        assert math.isclose(math.exp(weight), max(w for _, w in pairs), rel_tol=1e-9)
