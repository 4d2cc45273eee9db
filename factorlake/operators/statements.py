"""Filing facts: concept resolution, first filings, derived facts, long and wide statement forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .prefix_join import best_by_prefix

# Concept order per fact (the first one holding a value wins).
CONCEPTS = {
    "netIncome": ["NetIncomeLoss", "ProfitLoss"],
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"],
    "eps": ["EarningsPerShareBasic", "EarningsPerShareDiluted"],
    "grossProfit": ["GrossProfit"],
    "operatingIncome": ["OperatingIncomeLoss"],
    "stockholdersEquity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "assets": ["Assets"],
    "currentAssets": ["AssetsCurrent"],
    "currentLiabilities": ["LiabilitiesCurrent"],
    "sharesOutstanding": ["CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"],
    "operatingCashFlow": ["NetCashProvidedByUsedInOperatingActivities"],
    "costOfRevenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "capitalExpenditure": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets", "PaymentsToAcquireOtherPropertyPlantAndEquipment"],
}
DEBT_TOTAL = ["LongTermDebt", "DebtInstrumentCarryingAmount"]
DEBT_PARTS = ["LongTermDebtNoncurrent", "LongTermDebtCurrent", "DebtCurrent", "LongTermDebtCurrentMaturities"]
DEBT_EXTRA = ["CommercialPaper"]
INCOME_ANCHORS = ["netIncome", "revenue", "eps"]
MIN_PERIOD_DAYS = 300
MIN_ANNUAL_PERIODS, MAX_PERIOD_AGE_DAYS = 3, 550


def resolve_filings(facts: DataFrame, key: str = "cik") -> DataFrame:
    """Annual facts (key, concept, end, filed, val) to one wide row per (key, end, filed).

    Pure conditional aggregation on (key, end, filed): a fact is the first known of its concepts.
    """
    def one(concept: str) -> Column:
        return F.max_by(F.when(F.col("concept") == concept, F.col("val")), F.when(F.col("concept") == concept, F.col("pos")))
    wide = {f: F.coalesce(*[one(c) for c in cs]).alias(f) for f, cs in CONCEPTS.items()}
    d = facts.withColumn("pos", F.col("pos") if "pos" in facts.columns else F.lit(0))
    parts = [one(c) for c in DEBT_PARTS]
    any_part = F.coalesce(*parts)
    part_sum = F.when(any_part.isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    total = F.coalesce(*[one(c) for c in DEBT_TOTAL], part_sum)
    extra = sum((F.coalesce(one(c), F.lit(0.0)) for c in DEBT_EXTRA), F.lit(0.0))
    out = d.groupBy(key, "end", "filed").agg(*wide.values(), (total + extra).alias("totalDebt"))
    return (out.withColumn("grossProfit", F.coalesce("grossProfit", F.col("revenue") - F.col("costOfRevenue")))
            .withColumn("freeCashFlow", F.col("operatingCashFlow") - F.col("capitalExpenditure")))


def first_filings(filings: DataFrame, key: str = "cik") -> DataFrame:
    """One filing per period end: the earliest one that carries an income fact (later ones repeat it as a comparative)."""
    anchored = filings.filter(F.coalesce(*[F.col(a) for a in INCOME_ANCHORS]).isNotNull())
    rest = [c for c in filings.columns if c not in (key, "end")]
    return anchored.groupBy(key, "end").agg(F.min_by(F.struct(*rest), "filed").alias("f")).select(key, "end", "f.*")


def thin_periods(filings: DataFrame, key: str = "cik", min_days: int = MIN_PERIOD_DAYS) -> DataFrame:
    """Newest to oldest, keeps a period only at least ``min_days`` before the last kept one.

    A filer has tens of periods, so the greedy walk folds over one small array per filer.
    """
    rest = [c for c in filings.columns if c != key]
    item = F.struct("end", *[c for c in rest if c != "end"])
    d = filings.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(item))).alias("p"))
    kept = F.aggregate(
        F.slice("p", F.lit(2), F.size("p")), F.slice("p", 1, 1),
        lambda acc, x: F.when(F.datediff(F.element_at(acc, -1)["end"], x["end"]) >= min_days, F.concat(acc, F.array(x))).otherwise(acc))
    return d.select(key, F.explode(kept).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def filed_periods(facts: DataFrame, key: str = "cik") -> DataFrame:
    """Annual filings of a filer, one per fiscal year, dated by their own filing."""
    return thin_periods(first_filings(resolve_filings(facts, key), key), key)


def long_facts(wide: DataFrame, labels: dict[str, str], keys: list[str]) -> DataFrame:
    """Wide statement rows to (keys, fact, value) with canonical fact names; unknown labels drop out."""
    items = F.array(*[F.struct(F.lit(fact).alias("fact"), F.col(f"`{label}`").cast("double").alias("value"))
                      for label, fact in labels.items() if label in wide.columns])
    d = wide.select(*keys, F.explode(items).alias("f"))
    return d.select(*keys, "f.fact", "f.value")


def combine_statements(facts: DataFrame, priority: list[str], names: list[str], key: str = "ticker") -> DataFrame:
    """Wide facts per (ticker, period): the first statement holding the label supplies it, even as NULL."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("statement"))
    here = lambda n: F.col("fact") == n
    return facts.groupBy(key, "period_end").agg(
        *[F.min_by(F.when(here(n), F.struct("value")), F.when(here(n), rank)).getField("value").alias(n) for n in names])


def stitch_entities(periods: DataFrame, entities: DataFrame, today: Column) -> DataFrame:
    """A successor with few annual periods takes over the longest live series of a like-named filer.

    ``periods``: cik, period_end.  ``entities``: cik, ticker (NULL for candidates only), name, kind.
    A candidate's normalised name starts with one of the successor's search variants, found by an ordered
    merge of names and variants. Two candidates per variant do: the best one may be the successor itself.
    """
    stats = periods.groupBy("cik").agg(F.count("*").alias("n"), F.max("period_end").alias("newest"))
    e = entities.join(stats, "cik", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    norm = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
    short = e.filter(F.col("ticker").isNotNull() & (F.col("n") < MIN_ANNUAL_PERIODS))
    wanted = short.select(F.col("ticker"), F.col("cik").alias("own"), F.col("n").alias("own_n"), F.explode(X.search_variants("name")).alias("v")).withColumn("q", norm(F.col("v"))).drop("v")
    live = e.filter((F.col("kind") == "stock") & (F.datediff(today, F.col("newest")) <= MAX_PERIOD_AGE_DAYS))
    best = best_by_prefix(wanted.select("q"), live.select(norm(F.col("name")).alias("name"), F.col("cik").alias("id"), F.col("n").alias("weight")))
    hits = wanted.join(best.select("q", F.col("id").alias("cand"), F.col("weight").alias("cand_n")), "q").filter((F.col("cand") != F.col("own")) & (F.col("cand_n") > F.col("own_n")))
    return hits.groupBy("ticker", "own", "own_n").agg(
        F.max_by(F.struct("cand", "cand_n"), F.struct("cand_n", (-F.col("cand")).alias("k"))).alias("b")).select(
        "ticker", "own", "own_n", F.col("b.cand").alias("cik"), F.col("b.cand_n").alias("periods"))
