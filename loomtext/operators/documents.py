"""Documents as rows whose fields hold arrays of values: adding, removing and reading values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_value(values: Column, value: Column) -> Column:
    return F.concat(F.coalesce(values, F.array().cast("array<string>")), F.array(value))


def remove_first(values: Column) -> Column:
    """Without the first value; null when none is left."""
    return F.when(F.size(values) > 1, F.slice(values, F.lit(2), F.size(values) - 1))


def set_value(values: Column, value: Column) -> Column:
    """The first value replaced, or the value added."""
    rest = F.when(F.size(values) > 1, F.slice(values, F.lit(2), F.size(values) - 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(value), F.coalesce(rest, F.array().cast("array<string>")))


def first_value(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def joined_values(values: Column) -> Column:
    return F.array_join(values, " ")


def joined_bytes(values: Column) -> Column:
    """Binary values one after another."""
    return F.aggregate(values, F.lit(b""), lambda a, b: F.concat(a, b))


def field_names(fields: Column) -> Column:
    """Of a map from field to values."""
    return F.array_sort(F.map_keys(fields))


def entry_count(fields: Column) -> Column:
    return F.aggregate(F.map_values(fields), F.lit(0), lambda n, v: n + F.size(v))
