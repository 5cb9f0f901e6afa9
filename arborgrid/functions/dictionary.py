"""Dictionaries as JSON texts or maps: typed getters, merge, update, and values of unknown type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborgrid.operators.sets import merge_maps, remove_key


def get_json(c: Column, path: str, kind: str = "string") -> Column:
    """Value at a JSON path, as a type; null where it is missing or of another type."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def json_map(c: Column, value_type: str = "bigint") -> Column:
    """A flat JSON object as a map; null for texts that are no object."""
    return F.from_json(c, f"map<string,{value_type}>")


def map_json(c: Column) -> Column:
    """Minified JSON of a map."""
    return F.to_json(c)


def json_type(c: Column) -> Column:
    """Type of a JSON value, null if the text is no JSON."""
    return F.schema_of_variant(F.try_parse_json(c))


def update_json(c: Column, key: str, value: Column) -> Column:
    """A flat object with one value set."""
    return map_json(merge_maps(json_map(c), F.create_map(F.lit(key), value)))


def array_to_map(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


__all__ = ["array_to_map", "get_json", "json_map", "json_type", "map_json", "merge_maps", "remove_key", "update_json"]
