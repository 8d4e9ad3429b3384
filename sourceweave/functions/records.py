"""Array, struct and raw-JSON helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sorted(a: Column) -> Column:
    return F.array_sort(a) == a


def is_sorted_pair(people: Column) -> Column:
    return F.coalesce((F.size(people) == 2) & is_sorted(people), F.lit(False))


def has_repeats(a: Column) -> Column:
    return F.size(F.array_distinct(a)) != F.size(a)


def raw_keys(raw: Column) -> Column:
    """Keys of a JSON object given as text: what a typed read would drop."""
    return F.map_keys(F.from_json(raw, "map<string,string>"))


def key_present(raw: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(raw_keys(raw), key), F.lit(False))


def explicit_null(raw: Column, key: str) -> Column:
    """The key is there and says null, which is not the same as leaving it out."""
    m = F.from_json(raw, "map<string,string>")
    return F.coalesce(F.map_contains_key(m, key) & F.try_element_at(m, F.lit(key)).isNull(), F.lit(False))


def unknown_keys(raw: Column, allowed: Sequence[str]) -> Column:
    """Keys outside the allowed list, sorted; empty for NULL."""
    keys = F.coalesce(raw_keys(raw), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))


def letter_ids(one: Column, many: Column) -> Column:
    """Every document a source names: the single id first, then the list."""
    single = F.when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.concat(single, F.coalesce(many, F.array().cast("array<string>")))
