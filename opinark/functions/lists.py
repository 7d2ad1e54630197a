"""Lists kept as text, read by expressions: for columns whose notation is known. See operators/packed.py for unknown ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbers(c: Column | str) -> Column:
    """All decimals with point in a text, in order, with or without commas between; null gives none."""
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"[-+]?[0-9]*\.?[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: x.try_cast("double"))


def quoted(c: Column | str) -> Column:
    """All values in single quotes, in order."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit("'([^']*)'"), F.lit(1))


def strings(c: Column | str) -> Column:
    """JSON first, then the literal with single quotes, then whatever is in quotes; blank and nan give none."""
    from opinark.operators.triplets import json_like

    x = F.coalesce(F.trim(_c(c)), F.lit(""))
    return F.coalesce(F.from_json(x, "array<string>"), F.from_json(json_like(x), "array<string>"), quoted(x))


def remap(c: Column | str, names: dict[str, str], default: str) -> Column:
    """Values by a table, the default for others and null."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(table, _c(c)), F.lit(default))
