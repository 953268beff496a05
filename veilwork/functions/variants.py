"""Nodes of a VARIANT, by their own kind: nothing is cast from one kind to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node(value: Column, field: str) -> Column:
    """A field of an object; null if there is none."""
    return F.try_variant_get(value, f"$.{field}", "variant")


def text_of(value: Column) -> Column:
    """The string, if the node is one."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def list_of(value: Column) -> Column:
    """The items, if the node is a list."""
    return F.try_variant_get(value, "$", "array<variant>")


def fields_of(value: Column) -> Column:
    """The fields of an object as a map; null for other nodes."""
    return F.try_variant_get(value, "$", "map<string,variant>")
