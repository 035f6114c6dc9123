"""Records, maps and arrays."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "missing".
MISSING = ("", "N/A", "null", "None", "nan")


def present(c: Column) -> Column:
    """The value, or null where it is a text that means "missing"."""
    return F.when(~c.cast("string").isin(*MISSING), c)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor a text that means "missing"."""
    return F.coalesce(*(present(c) for c in columns))


def first_truthy(*columns: Column) -> Column:
    """The first value that is not null, empty or zero; null if there is none."""
    return F.coalesce(*(F.when((c.cast("string") != "") & ~F.coalesce(c.try_cast("double") == 0, F.lit(False)), c) for c in columns))


def display_text(fields: Mapping[str, str]) -> Column:
    """``name: value | name: value`` for the fields that aren't null."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in fields.items()))


def template(*lines: Column) -> Column:
    """Lines that aren't null, one below the other."""
    return F.concat_ws("\n", *lines)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_sequence(start: Column, end: Column) -> Column:
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array(start))


def row_as_map(cells: Column, headers: Sequence[str]) -> Column:
    """A row of cells as a map by header; short rows have nulls, cells beyond the headers are left out."""
    values = F.transform(F.sequence(F.lit(1), F.lit(len(headers))), lambda i: F.get(cells, i - 1))
    return F.map_from_arrays(F.array(*map(F.lit, headers)), values)


def renamed_keys(m: Column, aliases: Mapping[str, str]) -> Column:
    """A map with its keys renamed; the first entry whose value is neither null nor empty wins a name."""
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.coalesce(F.try_element_at(names, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    sound = F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    keys = F.array_distinct(F.transform(sound, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.transform(F.filter(sound, lambda e: e["key"] == k), lambda e: e["value"]), F.lit(0))))


def cells_of_span(start: Column, span: Column) -> Column:
    """Column numbers that a spanning cell covers."""
    return F.sequence(start, start + F.greatest(span, F.lit(1)) - 1)
