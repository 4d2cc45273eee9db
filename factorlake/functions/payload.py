"""Helpers for JSON payload columns whose shape varies between providers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from .numeric import col

OBJECTS = ArrayType(MapType(StringType(), StringType()))


def payload_map(text: Column | str) -> Column:
    """A payload object as ``map<string,string>``; nested values stay JSON text."""
    return F.from_json(col(text), MapType(StringType(), StringType()))


def percent_form(values: Column, keys: list[str]) -> Column:
    """Listed keys of a ``map<string,double>`` arrive as percent numbers: bring them to fractions."""
    return F.transform_values(values, lambda k, v: F.when(k.isin(keys), v / 100.0).otherwise(v))
