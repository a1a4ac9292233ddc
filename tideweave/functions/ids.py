"""Column functions on vertex ids and sets of neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vertex_of_hex(hex_id: Column) -> Column:
    """The vertex number in the first eight hex digits of a 12-byte id."""
    return F.conv(F.substring(hex_id, 1, 8), 16, 10).cast("long")


def hex_of_vertex(vertex: Column) -> Column:
    """A 12-byte hex id whose first four bytes are the vertex number."""
    return F.lower(F.concat(F.lpad(F.hex(vertex), 8, "0"), F.lit("0" * 16)))


def shared_neighbours(a: Column, b: Column) -> Column:
    """The size of the intersection of two neighbour arrays."""
    return F.size(F.array_intersect(a, b))


def as_text(items: Column) -> Column:
    """An array of ids, sorted and comma-joined."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x.cast("string")), ",")
