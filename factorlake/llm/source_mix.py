"""Mixing sources to target weights by exact word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable
from .ordered import running_totals

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row per source.

    Sources in code-point order, null last, take ``weights`` in turn and share ``share`` (a fraction) of all
    sizes. A target stops at ``most`` times its source's size and the excess goes to the others by weight
    until none is above: sources are sorted by size per weight, those whose cap lies below the level that
    the rest can reach are capped, and the level of the rest follows from the running totals of both. Both
    orders are range-sorted, so any number of sources will do. Sums stay whole numbers up to the last division.
    """
    numbered = running_totals(sizes.withColumn("__one", F.lit(1).cast("long")), None, [F.col("source").asc_nulls_last()], "__one", "__rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = numbered.select("source", "source_size", weight.alias("__w"), (F.col("source_size") * most).alias("__cap")).withColumn("__level", F.col("__cap") / F.col("__w"))
    order = [F.col("__level"), F.col("source").asc_nulls_last()]
    rows = running_totals(running_totals(rows, None, order, "__cap", "__caps"), None, order, "__w", "__ws")
    total, all_weights = (v or 0 for v in rows.agg(F.sum("source_size"), F.sum("__w")).first())
    left = F.lit(total * share[0]) - F.col("__caps") * share[1]  # what this and all later sources share, times the divisor
    full = F.col("__cap").cast("decimal(20,0)") * (F.lit(all_weights) - F.col("__ws")) * share[1] <= left.cast("decimal(20,0)") * F.col("__w")
    rows = stable(rows.withColumn("__full", full))
    capped, free = (v or 0 for v in rows.agg(F.sum(F.when(F.col("__full"), F.col("__cap"))), F.sum(F.when(~F.col("__full"), F.col("__w")))).first())
    share_out = F.col("__w") * (total * share[0] - capped * share[1]) / max(1, free * share[1])
    return rows.select("source", "source_size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(share_out).alias("target"))


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, keep: tuple[str, ...] = (),
           weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(key, source, size, source_size, target, taken, *keep) for every row of ``docs``.

    Rows get hash-random keys (MD5 of id and text), are sorted by range within their source, and the
    running total of sizes decides: whole epochs for all, then one more for the rows before the cut. The
    row on the cut is taken in part, so a source's taken words are its target, rounded down, and no row
    passes ``most`` times its size. The order depends on ids and texts alone, so reruns agree; rows
    alike in both are interchangeable. Null sources form a source, null texts and empty texts have size 0.
    """
    measured = docs.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("source"), (words(F.col(text)) if size is None else size).alias("size"),
                           F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("__order"),
                           *[F.col(k).alias(f"__keep_{k}") for k in keep])
    rows = stable(running_totals(stable(measured), "source", [F.col("__order"), F.col("size")], "size", "__before"))
    goal = stable(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    whole = F.floor("target").cast("long")
    goal = goal.select(F.col("source").alias("__s"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long").alias("__epochs"))
    goal = goal.withColumn("__last", F.floor("target").cast("long") - F.col("__epochs") * F.col("source_size"))
    taken = F.col("__epochs") * F.col("size") + F.least(F.greatest(F.col("__last") - F.col("__before"), F.lit(0)), F.col("size"))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("__s"))).select(F.col("__key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), *[F.col(f"__keep_{k}").alias(k) for k in keep])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space kept."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", epoch: str = "epoch", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2),
        most: int = 2) -> DataFrame:
    """The mix itself: one row per document and epoch it is taken in, with all columns of ``docs`` and ``epoch`` (from 0).

    The row on a source's cut keeps its first words only. Documents are stored once with a row number, which
    brings the decision back to them; an ``epoch`` column of ``docs`` is replaced.
    """
    stored = stable(docs.withColumn("__row", F.monotonically_increasing_id()))
    plan = decide(stored, key, text, source, keep=("__row",), weights=weights, share=share, most=most).where("taken > 0")
    plan = plan.select("__row", "size", F.posexplode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("__at", "__n"), "taken")
    part = F.col("__t.taken") - F.col("__t.__at") * F.col("__t.size")
    joined = stored.alias("__d").join(plan.alias("__t"), F.col("__d.__row") == F.col("__t.__row"))
    cut = F.when(part < F.col("__t.size"), first_words(F.col(f"__d.{text}"), part)).otherwise(F.col(f"__d.{text}"))
    return joined.select(*[cut.alias(c) if c == text else F.col(f"__d.`{c}`") for c in docs.columns if c != epoch], F.col("__t.__at").alias(epoch))
