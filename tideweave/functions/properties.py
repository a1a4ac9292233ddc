"""Dynamic properties of edges and vertices: a map from names to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_json_text(text: Column) -> Column:
    """The properties in a JSON object; null for null or malformed text."""
    return F.from_json(text, "map<string,string>")


def get_property(properties: Column, name: str, kind: str = "string") -> Column:
    """A property's value as a type; null if it is not there."""
    return F.try_element_at(properties, F.lit(name)).cast(kind)


def set_property(properties: Column, name: str, value: Column) -> Column:
    """The properties with one more, or with another value for it."""
    rest = F.map_filter(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value.cast("string")))
