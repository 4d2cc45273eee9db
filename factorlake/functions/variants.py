"""JSON payloads of open shape as VARIANT: typed access, and every object of a tree level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable
from .numeric import finite


def fields(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def number(v: Column) -> Column:
    """A finite JSON number; text and booleans are none."""
    d = F.try_variant_get(v, "$", "double")
    return F.when(d.isNotNull() & ~F.schema_of_variant(v).isin("STRING", "BOOLEAN"), finite(d))


def text(v: Column) -> Column:
    """Non-blank text, trimmed; other types are none."""
    t = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when((F.schema_of_variant(v) == "STRING") & (t != ""), t)


def member(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def first_number(m: Column, *keys: str) -> Column:
    """The first of these members that is a number."""
    return F.coalesce(*[number(member(m, k)) for k in keys])


def first_text(m: Column, *keys: str) -> Column:
    return F.coalesce(*[text(member(m, k)) for k in keys])


def _objects(array: Column) -> Column:
    return F.filter(F.transform(array, fields), lambda m: m.isNotNull())


def objects(m: Column, *keys: str) -> Column:
    """The objects of the first of these members that is a list with at least one."""
    found = [_objects(items(member(m, k))) for k in keys]
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in found])


def listed(v: Column, *keys: str) -> Column:
    """The objects of an array, or of an object's first list under ``keys``, or the object alone."""
    m = fields(v)
    return F.when(m.isNotNull(), F.coalesce(objects(m, *keys), F.array(m))).otherwise(_objects(items(v)))


def latest_block(v: Column) -> Column:
    """The newest period block of a period-major payload: the highest fiscal year, the first of equals or where none has a year.

    Blocks stand in an array, or in a ``data`` or ``periods`` list; an object without such a list is the block itself.
    """
    m = fields(v)
    inner = F.coalesce(items(member(m, "data")), items(member(m, "periods")))
    blocks = F.filter(F.coalesce(inner, items(v)), lambda b: fields(b).isNotNull())
    year = lambda b: F.coalesce(number(member(fields(b), "fiscalYear")), F.lit(float("-inf")))
    at = F.array_max(F.transform(blocks, lambda b, i: F.struct(year(b).alias("year"), (-i).alias("back"))))["back"]
    return F.when(m.isNotNull() & inner.isNull(), v).when(F.size(blocks) > 0, F.get(blocks, -at))


def object_nodes(rows: DataFrame, node: str, keep: list[str]) -> DataFrame:
    """(keep..., members) of every object in the tree of ``node``, at any depth, in as many rounds as the deepest tree has levels.

    Each round stores the containers of one level, so a payload is parsed once, no row holds more than it
    came with, and no depth is fixed; rows without a container below are done.
    """
    container = lambda c: fields(c).isNotNull() | items(c).isNotNull()
    level = stable(rows.select(*keep, F.col(node).alias("_v")).filter(container(F.col("_v"))))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = F.coalesce(F.map_values(fields(F.col("_v"))), items(F.col("_v")))
        below = F.flatten(F.transform(below, lambda c: F.coalesce(items(c), F.array(c))))  # a list and its elements in one round
        level = stable(level.select(*keep, F.explode(below).alias("_v")).filter(container(F.col("_v"))))
    found = reduce(DataFrame.unionByName, levels or [level])
    return found.select(*keep, fields(F.col("_v")).alias("members")).filter("members IS NOT NULL")


def scalars(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., key, value) for every scalar member of ``object_nodes``, as text; JSON nulls are left out."""
    d = nodes.select(*keep, F.explode("members").alias("key", "_v"))
    inside = fields(F.col("_v")).isNotNull() | items(F.col("_v")).isNotNull()
    return d.filter(~inside & ~F.is_variant_null("_v")).select(*keep, "key", F.try_variant_get("_v", "$", "string").alias("value"))
