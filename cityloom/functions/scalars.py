"""Text, number, hash and label helpers used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _c


def half_even(value, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(_c(value), digits)


def clamp(value, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(value)))


def ratio(numerator, denominator) -> Column:
    """NULL when the denominator is zero or missing."""
    d = _c(denominator)
    return F.when(d != 0, _c(numerator) / d)


def lookup(mapping: dict, key, default=None) -> Column:
    """Small fixed table as an expression (a few dozen entries at most)."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), _c(key))
    return found if default is None else F.coalesce(found, _c_lit(default))


def _c_lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def contains_any(text, words) -> Column:
    """Lower-cased text holds one of the words as a substring."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    return reduce(lambda a, b: a | b, [t.contains(w) for w in words])


def digits_only(text) -> Column:
    """Scenario ids may come as ``scn_12``: keep the digits; 0 and none are NULL."""
    n = F.regexp_replace(F.trim(_c(text).cast("string")), "[^0-9]", "")
    value = F.when(n != "", n.cast("long"))
    return F.when(value != 0, value)


def tag_number(text) -> Column:
    """Numeric map tag with an optional metre unit; junk becomes NULL."""
    t = F.lower(F.trim(_c(text).cast("string")))
    bare = F.trim(F.regexp_replace(t, "(meters|metres|m)$", ""))
    return bare.try_cast("double")


def jitter(key, low: float, high: float) -> Column:
    """Factor in [low, high) fixed by the key (first 32 bits of its MD5)."""
    h = F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("long")
    return low + (h % 1000) / 1000.0 * (high - low)


def title_label(name, labels: dict | None = None) -> Column:
    plain = F.initcap(F.replace(_c(name), F.lit("_"), F.lit(" ")))
    return plain if not labels else F.coalesce(lookup(labels, name), plain)


def parameter_hash(*fields: Column) -> Column:
    """SHA-256 over the JSON of the given (already name-sorted) fields."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def graph_signature(dataset_version, scenario_version, mode, builder_version) -> Column:
    parts = [F.coalesce(_c(p).cast("string"), F.lit("None"))
             for p in (dataset_version, scenario_version, mode, builder_version)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def parent_id(identifier) -> Column:
    """Identifier of the road a noded piece was cut from."""
    return F.substring_index(_c(identifier).cast("string"), "#", 1)
