"""Map functions as Column expressions: rows without a schema are maps of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def merged(low: Column | str, high: Column | str) -> Column:
    """The union of two maps; where both have a key, ``high`` wins."""
    low, high = _c(low), _c(high)
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def canonical_json(m: Column | str) -> Column:
    """JSON with the keys in order: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(m)))))


def keys_conflict(a: Column | str, b: Column | str) -> Column:
    """A key that both have, filled in, with different values (trimmed, in lower case)."""
    a, b = _c(a), _c(b)
    value = lambda m, k: F.lower(F.trim(F.element_at(m, k)))
    return F.exists(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda k: (value(a, k) != "") & (value(b, k) != "") & (value(a, k) != value(b, k)))


def with_key(m: Column | str, key: str, value: str | None = None) -> Column:
    """The map with a key added if it is absent."""
    m = _c(m)
    added = F.create_map(F.lit(key), F.lit(value).cast("string"))
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, added))


def without_key(m: Column | str, key: str) -> Column:
    return F.map_filter(_c(m), lambda k, _: k != key)
