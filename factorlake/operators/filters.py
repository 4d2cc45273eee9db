"""Row filters and set operations of the screening stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.numeric import ratio

# Listing currency -> region, cross-listing aliases are data (see canonical_ticker).
CURRENCY_REGION = {"USD": "us", "EUR": "eu", "GBP": "eu", "CHF": "eu", "DKK": "eu", "SEK": "eu", "NOK": "eu", "GBp": "eu",
                   "JPY": "asia", "HKD": "asia", "INR": "asia", "KRW": "asia", "TWD": "asia", "SGD": "asia", "AUD": "asia"}
DEFAULT_MIN_CAP = 2_000_000_000.0


def currency(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Listed currencies and rows without one; ``all`` keeps everything."""
    return df if "all" in allowed else df.filter(F.col("currency").isNull() | F.col("currency").isin(allowed))


def default_min_cap(min_cap: float | None, explicit_tickers: bool) -> float:
    if min_cap is not None:
        return min_cap
    return 0.0 if explicit_tickers else DEFAULT_MIN_CAP


def min_cap(df: DataFrame, cap: float, column: str = "market_cap") -> DataFrame:
    """Drops unknown and smaller caps once a floor is set."""
    return df.filter(F.col(column) >= cap) if cap > 0 else df


def early_cap_gate(prices: DataFrame, quotes: DataFrame, cap: float, key: str = "ticker") -> DataFrame:
    """Prices of assets worth scanning: an unknown cap passes, only a known smaller one is skipped."""
    if cap <= 0:
        return prices
    return prices.join(quotes.filter(F.col("market_cap").isNull() | (F.col("market_cap") >= cap)).select(key), key, "left_semi")


def sector_prefix(df: DataFrame, prefix: str | None) -> DataFrame:
    return df if not prefix else df.filter(F.lower("sector").startswith(prefix.lower()))


def asset_class(quote_type: Column) -> Column:
    return F.when(F.upper(quote_type) == "ETF", "ETF").otherwise("STOCK")


def without_errors(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.size("errors"), F.lit(0)) <= 0)


def region_codes(currencies: list[str]) -> list[str]:
    """Regions a currency filter can reach; an unknown currency reaches all, USD adds the consensus pool."""
    if "all" in currencies:
        return ["all"]
    found = {CURRENCY_REGION.get(c, "all") for c in currencies}
    if "all" in found:
        return ["all"]
    return sorted(found | ({"consensus"} if "us" in found else set()))


def select_pools(universe: DataFrame, wanted: str = "all", regions: list[str] | None = None) -> DataFrame:
    """Pools by class and region; the consensus pool joins every US-facing stock selection."""
    regions = regions or ["all"]
    d = universe if wanted == "all" else universe.filter(F.col("asset_class") == wanted)
    if "all" in regions:
        return d
    reach = list(regions) + (["consensus"] if "us" in regions else [])
    return d.filter(F.col("region").isin(reach))


def canonical_ticker(universe: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cross-listings to one ticker, only when more than one pool is merged."""
    many = universe.agg(F.min("pool").alias("a"), F.max("pool").alias("b")).select((F.col("a") != F.col("b")).alias("many")).scalar()
    d = universe.join(aliases.select(F.upper("alias").alias("_key"), "canonical"), F.upper("ticker") == F.col("_key"), "left")
    return d.withColumn("ticker", F.when(many & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.col("ticker"))).drop("_key", "canonical")


def distinct_pools(universe: DataFrame) -> DataFrame:
    """Case-insensitive distinct union; the first pool's spelling and order win.

    An aggregate with ``min_by`` combines on the map side, so a ticker repeated in many pools is cheap.
    """
    first = F.struct("pool", "ord", "ticker", "asset_class", "region")
    return (universe.groupBy(F.upper("ticker").alias("symbol")).agg(F.min_by(first, F.struct("pool", "ord", "ticker")).alias("f"))
            .select("symbol", "f.*"))


def exclude(df: DataFrame, holdings: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose ticker is not held (case-insensitive)."""
    held = holdings.select(F.upper(F.col(key).cast("string")).alias("_h")).distinct()
    return df.join(held, F.upper(F.col(key).cast("string")) == F.col("_h"), "left_anti")


def us_only(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    return df.filter(X.infer_region(symbol) == "us")


def report_filter(df: DataFrame, text: str | None = None, kind: str = "all", region: str = "all", min_score: float | None = None,
                  min_1m: float | None = None, min_12m: float | None = None) -> DataFrame:
    """Report page filters: text in ticker, name or sector; an unknown value fails a numeric minimum."""
    if text:
        t = text.strip().lower()
        df = df.filter(F.lower("symbol").contains(t) | F.lower("name").contains(t) | F.lower("sector").contains(t))
    if kind != "all":
        df = df.filter(F.lower("asset_type") == kind)
    if region != "all":
        df = df.filter(F.col("region") == region)
    for floor, c in ((min_score, F.col("score")), (min_1m, F.col("return_1m") * 100), (min_12m, F.col("return_12m") * 100)):
        if floor is not None:
            df = df.filter(c >= floor)
    return df


def report_order(column: str, descending: bool, tie: str = "symbol") -> list[Column]:
    """Unknown values last ascending, first descending."""
    c = F.col(column)
    return [c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col(tie).asc()]


def missing_sectors(held: DataFrame, all_sectors: list[str]) -> DataFrame:
    """Fixed sector list minus the sectors of a portfolio."""
    spark = held.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in all_sectors])).alias("sector"))
    return wanted.join(held.select("sector").distinct(), "sector", "left_anti")


# Provider sector name -> house name; anything else is kept.
HOUSE_SECTOR = {"Information Technology": "Technology", "Consumer Discretionary": "Consumer Cyclical", "Consumer Staples": "Consumer Defensive",
                "Health Care": "Healthcare", "Financials": "Financial Services", "Materials": "Basic Materials"}


def house_sector(sector: Column) -> Column:
    table = F.create_map(*[x for k, v in HOUSE_SECTOR.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, sector), sector)


# Exchange hint, ticker override and listing suffix -> two venue codes.
HINT_VENUES = {"NMS": ("NASDAQ", "NASDAQ"), "NGM": ("NASDAQ", "NASDAQ"), "NCM": ("NASDAQ", "NASDAQ"), "NYQ": ("NYSE", "NYSE"),
               "ASE": ("NYSEARCA", "AMEX"), "PCX": ("NYSEARCA", "AMEX"), "BTS": ("NYSE", "NYSE"), "TOR": ("TSE", "TSX"), "TSX": ("TSE", "TSX")}
TICKER_VENUES = {"HWM": ("NYSE", "NYSE"), "CRH": ("NYSE", "NYSE")}
SUFFIX_VENUES = {"": ("NASDAQ", "NASDAQ"), "DE": ("ETR", "XETR"), "F": ("FRA", "FWB"), "PA": ("EPA", "EURONEXT"), "AS": ("AMS", "EURONEXT"),
                 "L": ("LON", "LSE"), "MC": ("BME", "BME"), "MI": ("BIT", "MIL"), "SW": ("SWX", "SIX"), "ST": ("STO", "OMXSTO"), "CO": ("CPH", "OMXCOP"),
                 "HE": ("HEL", "OMXHEX"), "OL": ("OSL", "OSL"), "BR": ("BRU", "EURONEXT"), "T": ("TYO", "TSE"), "HK": ("HKG", "HKEX"), "SI": ("SGX", "SGX"),
                 "NS": ("NSE", "NSE"), "KS": ("KRX", "KRX"), "TW": ("TPE", "TWSE"), "AX": ("ASX", "ASX"), "TO": ("TSE", "TSX"), "SS": ("SHA", "SSE"), "SZ": ("SHE", "SZSE")}


def venue(ticker: Column, hint: Column, side: int) -> Column:
    """Venue code 0 or 1: exchange hint first, then the ticker override, then the listing suffix."""
    def lookup(table: dict, key: Column) -> Column:
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[side]))])
        return F.try_element_at(m, key)
    override = F.when(X.split_suffix(ticker) == "", lookup(TICKER_VENUES, X.split_base(ticker)))
    return F.coalesce(lookup(HINT_VENUES, F.upper(F.trim(hint))), override, lookup(SUFFIX_VENUES, X.split_suffix(ticker)))


def enrich(primary: DataFrame, secondary: DataFrame, key: str = "ticker") -> DataFrame:
    """Fills a missing cap or surprise; a suspicious row (P/E over 150 or P/B over 60) whose cap is off
    by more than 25 % is replaced as a whole."""
    cols = [c for c in primary.columns if c != key]
    s = secondary.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"s_{c}") for c in cols])
    d = primary.join(s, key, "left")
    odd = (F.col("trailing_pe") > 150) | (F.col("price_to_book") > 60)
    off = F.abs(ratio("market_cap", F.when(F.col("s_market_cap") != 0, F.col("s_market_cap"))) - 1.0) > 0.25
    swap = F.coalesce(F.col("_has") & odd & off & (F.col("market_cap") != 0), F.lit(False))
    fill = {"market_cap", "eps_surprise"}
    def pick(c):
        own = F.coalesce(F.col(c), F.col(f"s_{c}")) if c in fill else F.col(c)
        return F.when(swap, F.col(f"s_{c}")).otherwise(own).alias(c)
    return d.select(key, *[pick(c) for c in cols], swap.alias("replaced"))


def source_fallback(sources: list[DataFrame], key: str = "ticker") -> DataFrame:
    """First source that delivered the ticker without an error; an error row only when none did.

    An aggregate keeps one row per ticker on the map side before the shuffle.
    """
    stacked = None
    for i, s in enumerate(sources):
        d = s.withColumn("source", F.lit(i))
        stacked = d if stacked is None else stacked.unionByName(d, allowMissingColumns=True)
    bad = F.coalesce(F.size("errors"), F.lit(0)) > 0
    whole = F.struct(*[F.col(c) for c in stacked.columns if c != key])
    return stacked.groupBy(key).agg(F.min_by(whole, F.struct(bad.cast("int"), F.col("source"))).alias("r")).select(key, "r.*")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "info", 2).otherwise(9)
