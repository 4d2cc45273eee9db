"""Readers over landed files.  Every reader states its schema, reads permissively and normalises units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from ..functions import payload as P, variants as VA
from ..functions.numeric import finite, finite_number, sanitize_yield

# Flat field -> (module, key) of the nested quote payload; text fields are listed apart.
MODULE_FIELDS = {
    "trailing_pe": ("summaryDetail", "trailingPE"), "forward_pe": ("summaryDetail", "forwardPE"),
    "price_to_book": ("defaultKeyStatistics", "priceToBook"), "peg": ("defaultKeyStatistics", "pegRatio"),
    "trailing_peg": ("defaultKeyStatistics", "trailingPegRatio"), "return_on_equity": ("financialData", "returnOnEquity"),
    "return_on_assets": ("financialData", "returnOnAssets"), "profit_margin": ("defaultKeyStatistics", "profitMargins"),
    "earnings_growth": ("financialData", "earningsGrowth"), "revenue_growth": ("financialData", "revenueGrowth"),
    "debt_to_equity": ("financialData", "debtToEquity"), "current_ratio": ("financialData", "currentRatio"),
    "free_cashflow": ("financialData", "freeCashflow"), "dividend_yield": ("summaryDetail", "dividendYield"),
    "payout_ratio": ("summaryDetail", "payoutRatio"), "market_cap": ("summaryDetail", "marketCap"),
    "current_price": ("financialData", "currentPrice"), "regular_price": ("summaryDetail", "regularMarketPrice"),
    "previous_close": ("summaryDetail", "previousClose"), "total_assets": ("summaryDetail", "totalAssets"),
    "annual_expense_ratio": ("fundProfile", "annualReportExpenseRatio"), "net_expense_ratio": ("defaultKeyStatistics", "netExpenseRatio"),
    "three_year_return": ("defaultKeyStatistics", "threeYearAverageReturn"), "five_year_return": ("defaultKeyStatistics", "fiveYearAverageReturn"),
    "beta_3y": ("defaultKeyStatistics", "beta3Year"), "beta": ("summaryDetail", "beta"), "fund_yield": ("summaryDetail", "yield"),
    "trailing_dividend_yield": ("summaryDetail", "trailingAnnualDividendYield"), "nav_price": ("summaryDetail", "navPrice"),
}
MODULE_TEXT = {
    "short_name": ("quoteType", "shortName"), "long_name": ("quoteType", "longName"), "sector": ("summaryProfile", "sector"),
    "currency": ("summaryDetail", "currency"), "exchange": ("quoteType", "exchange"), "quote_type": ("quoteType", "quoteType"),
    "category": ("defaultKeyStatistics", "category"), "fund_family": ("defaultKeyStatistics", "fundFamily"),
}
QUOTE_NUMBERS = ["trailingPE", "priceToBook", "returnOnEquity", "returnOnAssets", "profitMargins", "earningsGrowth", "revenueGrowth", "debtToEquity",
                 "currentRatio", "freeCashflow", "payoutRatio", "marketCap", "currentPrice", "regularMarketPrice", "dividendYield", "epsSurprise",
                 "operatingCashflow", "capitalExpenditures", "totalAssets", "annualReportExpenseRatio", "netExpenseRatio", "yield", "beta3Year",
                 "threeYearAverageReturn", "fiveYearAverageReturn"]
QUOTE_TEXT = ["ticker", "quoteType", "shortName", "longName", "sector", "currency", "exchange", "regularMarketTime"]


def flatten_quotes(raw: DataFrame) -> DataFrame:
    """Quote text columns to typed ones: finite numbers only, ETF or STOCK by quote type."""
    aside = ["_extra"] if "_extra" in raw.columns else []
    d = raw.select(*QUOTE_TEXT, *[finite_number(c).alias(c) for c in QUOTE_NUMBERS], *aside)
    return d.withColumn("asset_type", F.when(F.upper("quoteType") == "ETF", "ETF").otherwise("STOCK")).withColumn(
        "name", F.coalesce(F.nullif("shortName", F.lit("")), F.col("longName"))).withColumn("dividendYield", sanitize_yield("dividendYield"))


def json_objects(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Landed JSON lines: the named members as text, the others aside in ``_extra``, a line that is no object in ``_broken``."""
    line = F.col("value")
    m = VA.fields(F.try_parse_json(line))
    d = spark.read.text(path).select(m.alias("m"), F.when(m.isNull(), line).alias("_broken"))
    as_text = lambda v: F.try_variant_get(v, "$", "string")
    extra = F.transform_values(F.map_filter("m", lambda k, _: ~k.isin(names)), lambda _, v: as_text(v))
    return d.select(*[as_text(VA.member(F.col("m"), n)).alias(n) for n in names], F.when(F.size(extra) > 0, extra).alias("_extra"), "_broken")


def rejected(rows: DataFrame) -> DataFrame:
    """The lines of a landed file that could not be read."""
    return rows.filter("_broken IS NOT NULL").select("_broken")


def quote_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_objects(spark, path, QUOTE_TEXT + QUOTE_NUMBERS)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Typed quotes of the readable lines; members nobody knows yet stay in ``_extra``."""
    return flatten_quotes(quote_lines(spark, path).filter("_broken IS NULL"))


def flatten_quote_modules(df: DataFrame, modules: Column | str = "modules", key: str = "ticker") -> DataFrame:
    """Nested provider modules (JSON text per ticker) to flat columns."""
    m = F.col(modules) if isinstance(modules, str) else modules
    d = df.select(key, F.from_json(m, MapType(StringType(), StringType())).alias("_m"))
    names = sorted({a for a, _ in [*MODULE_FIELDS.values(), *MODULE_TEXT.values()]})
    d = d.select(key, *[P.payload_map(F.try_element_at("_m", F.lit(n))).alias(f"_{n}") for n in names])
    number = lambda f: finite_number(F.try_element_at(F.col(f"_{f[0]}"), F.lit(f[1])))
    words = lambda f: F.nullif(F.try_element_at(F.col(f"_{f[0]}"), F.lit(f[1])), F.lit(""))
    fees = finite_number(F.try_element_at(P.payload_map(F.try_element_at("_fundProfile", F.lit("feesExpensesInvestment"))), F.lit("annualReportExpenseRatio")))
    out = d.select(key, *[number(f).alias(n) for n, f in MODULE_FIELDS.items()], *[words(f).alias(n) for n, f in MODULE_TEXT.items()], fees.alias("_fees"))
    return (out.withColumn("quote_type", F.upper("quote_type"))
            .withColumn("annual_expense_ratio", F.coalesce("annual_expense_ratio", F.col("_fees") * 100.0)).drop("_fees"))


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Adjusted closes preferred to plain ones; dates without a zone; rows without a date or a close drop out."""
    close = F.coalesce(finite_number("adjclose"), finite_number("close")) if "adjclose" in raw.columns else finite_number("close")
    keep = [finite_number(c).alias(c) for c in ("open", "high", "low") if c in raw.columns] + [F.col("volume").cast("string").try_cast("bigint").alias("volume") for _ in range("volume" in raw.columns)]
    return raw.select("ticker", F.col("session").cast("string").try_cast("date").alias("session"), *keep, close.alias("close")).filter("session IS NOT NULL AND close IS NOT NULL")


def price_rows(spark: SparkSession, path: str, fmt: str = "parquet", months: tuple[str, str] | None = None) -> DataFrame:
    """Landed bars below month partitions, CSV values as text; ``months`` (first, last) prunes partitions."""
    kind = (lambda t: "STRING") if fmt == "csv" else (lambda t: t)
    schema = ", ".join([f"ticker STRING, session {kind('DATE')}", *[f"{c} {kind('DOUBLE')}" for c in ("open", "high", "low", "close", "adjclose")], f"volume {kind('BIGINT')}", "month STRING"])
    r = spark.read.option("header", True) if fmt == "csv" else spark.read
    d = r.schema(schema).format(fmt).load(path)
    return d if months is None else d.filter(F.col("month").between(*months))


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", months: tuple[str, str] | None = None) -> DataFrame:
    return normalise_bars(price_rows(spark, path, fmt, months))


def adjust_ohlc(raw: DataFrame) -> DataFrame:
    """Split and dividend adjustment by adjClose / close; malformed rows drop out.

    Each text is parsed once per row: the generator keeps the optimizer from repeating the parsing in every factor and
    once more in the filter below them.
    """
    number = lambda c: F.col(c).cast("string").try_cast("double").alias(c)
    parsed = F.struct("ticker", F.col("date").cast("string").try_cast("date").alias("session"), *[number(c) for c in ("open", "high", "low", "close")],
                      number("adj_close"), F.coalesce(F.col("volume").cast("string").try_cast("bigint"), F.lit(0)).alias("volume"))
    d, adjusted, close = raw.select(F.inline(F.array(parsed))), F.col("adj_close"), F.col("close")
    adj = F.when(adjusted.isNull() | (adjusted == 0), close).otherwise(adjusted)
    factor = F.when(close > 0, F.try_divide(adj, close)).otherwise(1.0)
    return d.select("ticker", "session", *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low")], adj.alias("close"), "volume").dropna(
        subset=["session", "open", "high", "low", "close"])


def price_points(df: DataFrame, points: str = "data", key: str = "ticker") -> DataFrame:
    """``[[epoch_ms, value], ...]`` to sessions at midnight UTC."""
    d = df.select(key, F.explode(points).alias("p"))
    return d.select(key, F.to_date(F.timestamp_millis(F.get("p", F.lit(0)).cast("bigint"))).alias("session"), F.get("p", F.lit(1)).alias("close"))


def read_price_points(spark: SparkSession, path: str) -> DataFrame:
    return price_points(spark.read.schema("ticker STRING, data ARRAY<ARRAY<DOUBLE>>").json(path))


PIT_SCHEMA = StructType([StructField(c, StringType()) for c in ("ticker", "statement", "period", "fiscalYear", "fiscalPeriod", "dateFiled")]
                        + [StructField("facts", MapType(StringType(), DoubleType()))])


def parse_periods(raw: DataFrame) -> DataFrame:
    """Filing rows to periods with the day they became public; rows with bad or missing dates drop out."""
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    return raw.select("ticker", "statement", day("period").alias("period_end"), F.coalesce(F.col("fiscalYear").try_cast("int"), F.lit(0)).alias("fiscal_year"),
                      F.coalesce("fiscalPeriod", F.lit("")).alias("fiscal_period"), day("dateFiled").alias("date_filed"),
                      F.coalesce("facts", F.create_map().cast("map<string,double>")).alias("facts")).filter("period_end IS NOT NULL AND date_filed IS NOT NULL")


def read_pit_statements(spark: SparkSession, path: str) -> DataFrame:
    return parse_periods(spark.read.schema(PIT_SCHEMA).json(path))


_ROW = StructType([StructField("end", StringType()), StructField("filed", StringType()), StructField("val", DoubleType()),
                   StructField("form", StringType()), StructField("fp", StringType())])
COMPANYFACTS = MapType(StringType(), MapType(StringType(), StructType([StructField("units", MapType(StringType(), ArrayType(_ROW)))])))


def flatten_companyfacts(df: DataFrame, facts: str = "facts", key: str = "cik") -> DataFrame:
    """Concept map to (key, concept, end, filed, val, pos): us-gaap, annual 10-K rows only.

    ``pos`` is the position inside the payload: on a repeated (concept, end, filed) the last row wins.
    """
    d = df.select(key, F.explode(F.try_element_at(F.col(facts), F.lit("us-gaap"))).alias("concept", "node"))
    d = d.select(key, "concept", F.explode("node.units").alias("unit", "rows")).select(key, "concept", "unit", F.posexplode("rows").alias("i", "r"))
    d = d.filter((F.col("r.form") == "10-K") & (F.col("r.fp") == "FY") & F.col("r.val").isNotNull())
    d = d.select(key, "concept", F.col("r.end").try_cast("date").alias("end"), F.col("r.filed").try_cast("date").alias("filed"), F.col("r.val").alias("val"), F.struct("unit", "i").alias("pos"))
    d = d.filter("end IS NOT NULL AND filed IS NOT NULL")
    return d.groupBy(key, "concept", "end", "filed").agg(F.max_by("val", "pos").alias("val"))


def ttm_block(df: DataFrame, text: str = "payload", key: str = "ticker") -> DataFrame:
    """First ``facts`` block of a trailing response, wrapped or bare; a symbol response beats a CIK one."""
    m = P.payload_map(F.col(text))
    bare = F.try_element_at(m, F.lit("facts"))
    listed = F.coalesce(F.from_json(F.try_element_at(m, F.lit("data")), P.OBJECTS), F.from_json(F.col(text), P.OBJECTS))
    facts = P.payload_map(F.coalesce(F.try_element_at(F.get(listed, F.lit(0)), F.lit("facts")), bare))
    d = df.withColumn("facts", facts).filter(F.size("facts") > 0)
    if "selector" in df.columns:
        d = d.groupBy(key).agg(F.min_by("facts", F.when(F.col("selector") == "symbol", 0).otherwise(1)).alias("facts"))
    return d.select(key, F.transform_values("facts", lambda _, v: finite_number(v)).alias("facts"))


def read_dividends(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("ticker STRING, ex_date TIMESTAMP, amount DOUBLE").parquet(path)
    return d.select("ticker", F.to_date("ex_date").alias("ex_date"), finite("amount").alias("amount")).filter("amount IS NOT NULL")


def last_per_stamp(earnings: DataFrame, order: str, key: str = "ticker") -> DataFrame:
    """One row per ticker and report stamp; the last landed row wins."""
    rest = [c for c in earnings.columns if c not in (key, "reported_at", order)]
    return earnings.groupBy(key, "reported_at").agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "reported_at", "r.*")


def read_earnings(spark: SparkSession, path: str) -> DataFrame:
    schema = "ticker STRING, reported_at TIMESTAMP, eps_estimate DOUBLE, eps_reported DOUBLE, surprise_pct DOUBLE, landed BIGINT"
    return last_per_stamp(spark.read.schema(schema).parquet(path), "landed")


def surprise_from_actuals(rows: DataFrame, key: str = "ticker", k: int = 4) -> DataFrame:
    """Newest ``k`` entries first, then the unusable ones are skipped: (actual - estimate) / |estimate|, percent."""
    w = Window.partitionBy(key).orderBy(F.col("date").desc())
    d = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    s = F.try_divide(F.col("actual") - F.col("estimate"), F.abs("estimate")) * 100.0
    return d.groupBy(key).agg(F.avg(s).alias("eps_surprise"))


# Markup patterns of a holdings page.
ROW_PATTERN = r"(?s)<tr[^>]*>(.*?)</tr>"
STOCK_PATTERN = r'(?s)<td class="stock">.*?<a href="/m/stock\.php\?sym=([^"]+)">'
PCT_PATTERN = r'(?s)<td class="stock">.*?</td>\s*<td[^>]*>([\d.,]+)</td>'
MANAGER_PATTERN = r'<a href="/m/holdings\.php\?m=[^"]+"[^>]*>[^<]+</a>'
PERIOD_PATTERN = r"(Q[1-4]\s+\d{4})"


def extract_holdings(pages: DataFrame, html: str = "html", key: str = "manager") -> DataFrame:
    """Holdings rows of manager pages; the first occurrence of a symbol on a page wins."""
    d = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(ROW_PATTERN), F.lit(1))).alias("pos", "row"))
    d = d.select(key, "pos", F.regexp_extract("row", STOCK_PATTERN, 1).alias("symbol"),
                 F.regexp_replace(F.regexp_extract("row", PCT_PATTERN, 1), ",", "").try_cast("double").alias("pct"))
    d = d.filter((F.col("symbol") != "") & F.col("pct").isNotNull())
    return d.groupBy(key, "symbol").agg(F.min_by("pct", "pos").alias("pct"))


def extract_managers(pages: DataFrame, html: str = "html") -> DataFrame:
    d = pages.select(F.explode(F.regexp_extract_all(html, F.lit(f"({MANAGER_PATTERN})"), F.lit(1))).alias("a"))
    return d.select(F.regexp_extract("a", r'm=([^"]+)"', 1).alias("code"), F.trim(F.regexp_extract("a", r">([^<]+)</a>", 1)).alias("name"))


def report_period(html: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.col(html) if isinstance(html, str) else html, PERIOD_PATTERN, 1), r"\s+", " "), F.lit(""))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of web pages; the first position of a target on a page is kept."""
    d = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)"'), F.lit(1))).alias("pos", "href"))
    return d.groupBy("page_id", "href").agg(F.min("pos").alias("first_pos"), F.count("*").alias("times"))


def read_index_series(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("symbol STRING, session DATE, close DOUBLE").parquet(path)
    return d.withColumn("close", finite("close")).filter("close IS NOT NULL")


def read_treasury_curve(spark: SparkSession, path: str) -> DataFrame:
    """Official par-yield rows; only rows with a date and both tenors."""
    d = spark.read.option("header", True).csv(path)
    return d.select(F.try_to_timestamp("Date", F.lit("MM/dd/yyyy")).cast("date").alias("session"), finite_number("`10 Yr`").alias("y10"),
                    finite_number("`2 Yr`").alias("y2")).dropna()


# Sub-indicator key -> name.
SENTIMENT_KEYS = {"market_momentum_sp125": "market_momentum", "stock_price_strength": "stock_price_strength", "stock_price_breadth": "stock_price_breadth",
                  "put_call_options": "put_call_options", "market_volatility_vix_50": "market_volatility", "junk_bond_demand": "junk_bond_demand",
                  "safe_haven_demand": "safe_haven_demand"}


def parse_sentiment(raw: DataFrame, text: str = "value") -> DataFrame:
    """Composite score, rating and instant, then one row per known sub-indicator."""
    m = P.payload_map(F.col(text))
    d = raw.select(m.alias("m"))
    node = lambda k: P.payload_map(F.try_element_at("m", F.lit(k)))
    rating = lambda n: F.nullif(F.lower(F.trim(F.try_element_at(n, F.lit("rating")))), F.lit(""))
    top = node("fear_and_greed")
    stamp = F.try_element_at(top, F.lit("timestamp"))
    ms = stamp.try_cast("double")
    at = F.coalesce(F.timestamp_millis(ms.cast("bigint")), F.when(ms.isNull(), stamp.try_cast("timestamp")))
    subs = F.array(*[F.struct(F.lit(n).alias("name"), node(k).alias("n")) for k, n in SENTIMENT_KEYS.items()])
    d = d.select(finite_number(F.try_element_at(top, F.lit("score"))).alias("score"), rating(top).alias("rating"), at.alias("at"), F.explode(subs).alias("s"))
    return d.filter(F.col("s.n").isNotNull()).select("score", "rating", "at", F.col("s.name").alias("indicator"),
                                                     finite_number(F.try_element_at(F.col("s.n"), F.lit("score"))).alias("sub_score"), rating(F.col("s.n")).alias("sub_rating"))


def read_sentiment(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """One payload per file, or per line; what is no payload gives no row."""
    return parse_sentiment(spark.read.option("wholetext", not per_line).text(path))


def read_footnotes(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, kind, payload VARIANT, broken): landed payload text, parsed once.

    Text that is no JSON keeps its row with a null payload and the text in ``broken``, so nothing is lost silently.
    """
    d = spark.read.schema("ticker STRING, kind STRING, payload STRING").json(path)
    v = F.try_parse_json("payload")
    return d.select("ticker", "kind", v.alias("payload"), F.when(v.isNull(), F.col("payload")).alias("broken"))


def footnote_lake(spark: SparkSession, path: str) -> DataFrame:
    """Payloads as ``sinks.save_footnotes`` stored them: a filter on ``kind`` prunes partitions."""
    return spark.read.schema("ticker STRING, payload VARIANT, broken STRING, kind STRING").parquet(path)


CHART = "periods ARRAY<STRING>, series ARRAY<STRUCT<name: STRING, data: ARRAY<DOUBLE>>>, rates ARRAY<STRUCT<name: STRING, data: ARRAY<DOUBLE>>>"
# Chart series name -> metric.
CHART_METRICS = {"Revenue": "revenue", "Gross Margin": "gross_margin", "Operating Margin": "operating_margin", "Net Margin": "net_margin",
                 "FCF / Net Income": "fcf_to_ni", "OCF / Net Income": "ocf_to_ni", "Debt to Equity": "debt_to_equity", "Current Ratio": "current_ratio"}


def insight_periods(charts: DataFrame, chart: str = "chart", key: str = "ticker") -> DataFrame:
    """Chart payloads (several per ticker) merged to one row per fiscal period.

    Every (period, series, value) triple is stacked and pivoted over the fixed metric list, so the
    payloads of a ticker need no join with each other.
    """
    c = F.from_json(F.col(chart), CHART) if dict(charts.dtypes)[chart] == "string" else F.col(chart)
    d = charts.select(key, c.alias("c"))
    everything = F.concat(F.coalesce("c.series", F.array()), F.coalesce("c.rates", F.array()))
    d = d.select(key, F.col("c.periods").alias("periods"), F.explode(everything).alias("s"))
    d = d.select(key, F.col("s.name").alias("name"), F.explode(F.arrays_zip(F.col("periods").alias("period_end"), F.col("s.data").alias("v"))).alias("z"))
    d = d.filter("z.period_end IS NOT NULL")
    return d.groupBy(key, F.col("z.period_end").alias("period_end")).agg(
        *[F.max(F.when(F.col("name") == n, finite(F.col("z.v")))).alias(m) for n, m in CHART_METRICS.items()])


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts TIMESTAMP, kind STRING, symbol STRING").json(path)


def parse_ticker_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tickers separated by whitespace or commas; '#' starts a comment."""
    d = lines.select(F.explode(F.split(F.regexp_replace(column, r"#.*", ""), r"[\s,]+")).alias("ticker"))
    return d.filter(F.col("ticker") != "")


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_lines(spark.read.text(path))


def read_price_panel(spark: SparkSession, path: str, min_bars: int = 500) -> DataFrame:
    """Wide CSV of closes (first column the session) to long rows; short instruments drop out."""
    from ..operators.allocation import long_enough
    wide = spark.read.option("header", True).csv(path)
    first, *names = wide.columns
    long = wide.unpivot([first], names, "instrument", "close")
    long = long.select(F.col(first).try_cast("date").alias("session"), "instrument", finite_number("close").alias("close")).filter("close IS NOT NULL AND session IS NOT NULL")
    return long_enough(long, "instrument", min_bars)


def statement_rows(wide: DataFrame, label: str = "label", keys: tuple[str, ...] = ("ticker", "statement")) -> DataFrame:
    """A statement with one column per fiscal date (rows = labels) to long facts."""
    dates = [c for c in wide.columns if c not in (*keys, label)]
    long = wide.unpivot([*keys, label], dates, "period_end", "value")
    table = F.create_map(*[x for k, v in STATEMENT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return long.select(*keys, F.col("period_end").try_cast("date").alias("period_end"), F.try_element_at(table, F.col(label)).alias("fact"),
                       F.col("value").cast("double").alias("value")).filter("fact IS NOT NULL AND period_end IS NOT NULL")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Landed statement tables as long facts."""
    return statement_rows(spark.read.parquet(path))


# Statement label -> canonical fact.
STATEMENT_LABELS = {"Net Income": "net_income", "Total Revenue": "revenue", "Basic EPS": "eps", "Diluted EPS": "eps_diluted", "Gross Profit": "gross_profit",
                    "EBIT": "ebit", "Stockholders Equity": "equity", "Total Assets": "total_assets", "Total Debt": "total_debt", "Current Assets": "current_assets",
                    "Current Liabilities": "current_liabilities", "Ordinary Shares Number": "shares", "Free Cash Flow": "fcf", "Operating Cash Flow": "ocf",
                    "Retained Earnings": "retained_earnings", "Total Liabilities Net Minority Interest": "total_liabilities"}
