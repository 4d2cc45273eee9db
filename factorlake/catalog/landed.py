"""Readers and writers over files that are derived from the tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..sources import driver_views as V, readers as RD, sinks as SK
from .registry import query
from .sqlviews import compose
from .streams import _folder


@query("landed_dividends", "SRC-10 JOIN-6 AGG-3", compose(
    """SELECT 'T' || ticker AS ticker, COUNT(*) AS payments, ROUND(COALESCE(SUM(CASE WHEN ex_date >= e - 365 AND ex_date < e THEN amount END), 0) / 100e0, 6) AS ttm_div
 FROM dividends, (SELECT MAX(ex_date) AS e FROM dividends) GROUP BY 1"""))
def landed_dividends(spark, sf_dir):
    """Payments of fractional amounts over the year before the newest ex-date of all."""
    path = f"{_folder(spark)}/dividends"
    V.dividends(spark, sf_dir).select(F.concat(F.lit("T"), F.col("ticker")).alias("ticker"), F.col("ex_date").cast("timestamp").alias("ex_date"), F.col("amount").cast("double").alias("amount")).write.parquet(path)
    d = RD.read_dividends(spark, path)
    end = d.agg(F.max("ex_date")).scalar()
    paid = A.amounts_by_ticker(d).withColumn("end", end)
    return paid.select("ticker", F.size("payments").cast("bigint").alias("payments"), F.round(A.paid_between(F.col("payments"), F.date_sub("end", 365), F.col("end")), 6).alias("ttm_div"))


@query("landed_earnings", "SRC-11", compose("SELECT 'T' || ticker AS ticker, CAST(reported_at AS DATE) AS day, CAST(eps_reported AS DOUBLE) AS eps_reported, CAST(eps_estimate AS DOUBLE) AS eps_estimate FROM earnings"))
def landed_earnings(spark, sf_dir):
    """Every report landed twice, the first time with a wrong figure: the last landed row wins."""
    path = f"{_folder(spark)}/earnings"
    e = V.earnings(spark, sf_dir).select(F.concat(F.lit("T"), F.col("ticker")).alias("ticker"), F.col("reported_at").cast("timestamp").alias("reported_at"), F.col("eps_estimate").cast("double").alias("eps_estimate"),
                                         F.col("eps_reported").cast("double").alias("eps_reported"), F.col("surprise_pct").cast("double").alias("surprise_pct"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("landed"))
    e.withColumn("eps_reported", F.when(F.col("landed") == 1, F.col("eps_reported")).otherwise(-1.0)).write.parquet(path)
    return RD.read_earnings(spark, path).select("ticker", F.to_date("reported_at").alias("day"), "eps_reported", "eps_estimate")


@query("landed_index", "SRC-13", compose("SELECT symbol, session, ROUND(close, 6) AS close FROM index_series WHERE day(session) % 7 <> 0"))
def landed_index(spark, sf_dir):
    """Every seventh day of a month has no finite close and is left out."""
    path = f"{_folder(spark)}/index"
    V.index_series(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("session") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("close"))).write.parquet(path)
    return RD.read_index_series(spark, path).select("symbol", "session", F.round("close", 6).alias("close"))


@query("landed_filings", "SRC-18", "SELECT event_type AS kind, COUNT(*) AS filings, COUNT(DISTINCT user_id) AS symbols, CAST(MIN(ts) AS DATE) AS first_day, CAST(MAX(ts) AS DATE) AS last_day FROM events GROUP BY 1")
def landed_filings(spark, sf_dir):
    path = f"{_folder(spark)}/filings"
    V.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("symbol")).write.json(path)
    d = RD.read_filings(spark, path)
    return d.groupBy("kind").agg(F.count("*").alias("filings"), F.countDistinct("symbol").alias("symbols"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@query("landed_holdings", "SRC-12", compose("SELECT CAST(manager AS BIGINT) AS manager, symbol, ROUND(bps / 100e0, 2) AS pct FROM holdings"))
def landed_holdings(spark, sf_dir):
    """Manager pages of markup, one row per holding, with a repeated row of another weight that must lose.

    A manager has as many pages as symbols need, at 256 symbols a page; both rows of a symbol are on one page.
    """
    row = F.concat(F.lit('<tr class="x"><td class="stock"> <a href="/m/stock.php?sym='), F.col("symbol"), F.lit('">s</a></td> <td class="p">'), F.format_string("%.2f", F.col("bps") / 100.0), F.lit("</td></tr>"))
    again = F.regexp_replace(row, r">[\d.]+</td>", ">99.99</td>")
    h = V.holdings(spark, sf_dir)
    per_manager = h.groupBy("manager").agg(F.ceil(F.count("*") / 256).alias("pages"))
    page = F.pmod(F.xxhash64("symbol"), F.col("pages")).alias("page")
    pages = h.join(per_manager, "manager").groupBy("manager", page).agg(F.concat_ws("\n", F.collect_list(row), F.collect_list(again)).alias("html"))
    path = f"{_folder(spark)}/managers"
    pages.write.parquet(path)
    return RD.extract_holdings(spark.read.parquet(path)).select(F.col("manager").cast("bigint").alias("manager"), "symbol", F.round("pct", 2).alias("pct"))


@query("written_ic", "SNK-3", compose("SELECT symbol AS metric, COUNT(*) AS snapshots, ROUND(AVG(close), 6) AS mean_ic FROM index_series GROUP BY 1"))
def written_ic(spark, sf_dir):
    """A table of the coefficient report's shape, written as CSV with a header and read back by name."""
    path = f"{_folder(spark)}/ic"
    SK.write_ic(V.index_series(spark, sf_dir).groupBy(F.col("symbol").alias("metric")).agg(F.count("*").alias("snapshots"), F.round(F.avg("close"), 6).alias("mean_ic")), path)
    return spark.read.option("header", True).schema("metric STRING, snapshots BIGINT, mean_ic DOUBLE").csv(path)


@query("written_comparison", "SNK-6", compose("SELECT symbol AS field, COUNT(*) AS compared, ROUND(MAX(close), 6) AS max_rel_diff FROM index_series GROUP BY 1"))
def written_comparison(spark, sf_dir):
    path = f"{_folder(spark)}/comparison"
    SK.write_source_comparison(V.index_series(spark, sf_dir).groupBy(F.col("symbol").alias("field")).agg(F.count("*").alias("compared"), F.round(F.max("close"), 6).alias("max_rel_diff")), path)
    return spark.read.schema("field STRING, compared BIGINT, max_rel_diff DOUBLE").json(path)


# ---- landed files with damaged rows -----------------------------------------------------------------

@query("landed_quotes", "SRC-1", compose(
    """SELECT asset_type, COUNT(*) FILTER (ticker % 10 <> 7) AS quotes, COUNT(*) FILTER (ticker % 10 = 7) AS rejected, COUNT(*) FILTER (ticker % 10 <> 7 AND ticker % 3 = 0) AS drifted,
 ROUND(SUM(CASE WHEN ticker % 10 <> 7 AND ticker % 4 <> 1 THEN total_assets END), 2) AS total_assets, ROUND(SUM(CASE WHEN ticker % 10 <> 7 THEN (ticker % 9) / 100e0 END), 6) AS dividend_yield FROM profiles GROUP BY 1"""))
def landed_quotes(spark, sf_dir):
    """JSON lines of quotes: every tenth cut off, every third with a member nobody knows, numbers as text or not finite, yields as percent."""
    p = V.profiles(spark, sf_dir)
    k = F.col("ticker")
    percent = F.when(k % 9 > 1, (k % 9).cast("double")).otherwise((k % 9) / 100.0)  # a yield above one is a percent figure
    fields = F.struct(F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.when(F.col("asset_type") == "ETF", "etf").otherwise("EQUITY").alias("quoteType"), F.col("name").alias("longName"), F.lit("").alias("shortName"), "currency",
                      F.when(k % 4 == 1, "NaN").otherwise(F.col("total_assets").cast("string")).alias("totalAssets"), percent.alias("dividendYield"), F.when(k % 3 == 0, F.lit(1)).alias("newMember"))
    line = F.to_json(fields)
    path = f"{_folder(spark)}/quotes"
    p.select("asset_type", F.when(k % 10 == 7, F.concat(F.substring(line, 1, 30), F.col("asset_type"))).otherwise(line).alias("value")).select("value").write.text(path)
    good, bad = RD.read_quotes(spark, path), RD.rejected(RD.quote_lines(spark, path))
    counts = bad.groupBy(F.when(F.col("_broken").endswith("ETF"), "ETF").otherwise("STOCK").alias("asset_type")).agg(F.count("*").alias("rejected"))
    d = good.groupBy("asset_type").agg(F.count("*").alias("quotes"), F.count("_extra").alias("drifted"), F.round(F.sum("totalAssets"), 2).alias("total_assets"), F.round(F.sum("dividendYield"), 6).alias("dividend_yield"))
    return d.join(counts, "asset_type", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))


@query("landed_prices", "SRC-3", compose(
    """SELECT 'T' || ticker AS ticker, COUNT(*) FILTER (day(session) % 11 <> 0 AND ticker % 7 <> 3) AS bars, COUNT(*) FILTER (day(session) % 11 = 0 OR ticker % 7 = 3) AS rejected,
 ROUND(SUM(CASE WHEN day(session) % 11 <> 0 AND ticker % 7 <> 3 THEN close * CASE WHEN day(session) % 5 = 0 THEN 1 ELSE 2 END END), 4) AS total FROM prices WHERE session BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' GROUP BY ticker"""))
def landed_prices(spark, sf_dir):
    """CSV bars by month: days without a date, tickers without a number, an adjusted close on most days; only the asked months are read."""
    day = F.dayofmonth("session")
    p = V.prices(spark, sf_dir).withColumn("month", F.date_format("session", "yyyy-MM"))
    text = F.when(F.col("ticker") % 7 == 3, "n/a").otherwise(F.col("close").cast("string"))
    rows = p.select(F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker"), F.when(day % 11 == 0, "soon").otherwise(F.col("session").cast("string")).alias("session"), *[F.lit("x").alias(c) for c in ("open", "high", "low")],
                    text.alias("close"), F.when((day % 5 != 0) & (F.col("ticker") % 7 != 3), (F.col("close") * 2).cast("string")).alias("adjclose"), F.lit("5").alias("volume"), "month")
    path = f"{_folder(spark)}/prices"
    SK.save_prices(rows, path, "csv")
    asked = ("1996-01", "1997-06")
    good = RD.read_prices(spark, path, "csv", asked).groupBy("ticker").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("total"))
    every = RD.price_rows(spark, path, "csv", asked).groupBy("ticker").agg(F.count("*").alias("rows"))
    d = every.join(good, "ticker", "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    return d.select("ticker", "bars", (F.col("rows") - F.col("bars")).alias("rejected"), "total")


@query("landed_curve", "SRC-14", compose("""SELECT session, ROUND(MAX(CASE WHEN symbol = 'click' THEN close END), 4) AS y10, ROUND(MAX(CASE WHEN symbol = 'view' THEN close END), 4) AS y2 FROM index_series
 WHERE day(session) % 6 <> 0 GROUP BY 1 HAVING y10 IS NOT NULL AND y2 IS NOT NULL AND day(session) % 9 <> 0"""))
def landed_curve(spark, sf_dir):
    """Par-yield rows of official CSV files; days with another date form or a missing tenor do not count."""
    d = V.index_series(spark, sf_dir).groupBy("session").agg(*[F.round(F.max(F.when(F.col("symbol") == s, F.col("close"))), 4).alias(c) for s, c in (("click", "10 Yr"), ("view", "2 Yr"))])
    day = F.dayofmonth("session")
    rows = d.select(F.date_format("session", "MM/dd/yyyy").alias("Date"), F.when(day % 9 == 0, "N/A").otherwise(F.col("`2 Yr`").cast("string")).alias("2 Yr"), F.col("`10 Yr`").cast("string").alias("10 Yr"), day.alias("d"))
    rows = rows.withColumn("Date", F.when(F.col("d") % 6 == 0, F.concat(F.lit("day "), F.col("Date"))).otherwise(F.col("Date"))).drop("d")
    path = f"{_folder(spark)}/curve"
    rows.write.option("header", True).csv(path)
    return RD.read_treasury_curve(spark, path)


@query("landed_sentiment", "SRC-15", compose("""SELECT CAST(epoch_ms(session) AS BIGINT) AS at_ms, ROUND(AVG(close) OVER (PARTITION BY session), 4) AS score, CASE WHEN symbol = 'click' THEN 'market_momentum' ELSE 'junk_bond_demand' END AS indicator,
 ROUND(close, 4) AS sub_score, 'greed' AS sub_rating FROM index_series WHERE symbol IN ('click', 'view') AND day(session) % 6 <> 0"""))
def landed_sentiment(spark, sf_dir):
    """A payload per line and day; every sixth day is cut off, one indicator has no rating that is known by name."""
    d = V.index_series(spark, sf_dir).filter(F.col("symbol").isin("click", "view")).groupBy("session").agg(F.avg("close").alias("score"), *[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(s) for s in ("click", "view")])
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("score"), F.lit(" Greed ").alias("rating")))
    top = F.struct("score", F.lit("").alias("rating"), F.unix_millis(F.col("session").cast("timestamp")).alias("timestamp"))
    line = F.to_json(F.struct(top.alias("fear_and_greed"), node("click").alias("market_momentum_sp125"), node("view").alias("junk_bond_demand"), node("view").alias("unknown_indicator")))
    path = f"{_folder(spark)}/sentiment"
    d.select(F.when(F.dayofmonth("session") % 6 == 0, F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(path)
    s = RD.read_sentiment(spark, path, per_line=True)
    return s.select(F.unix_millis("at").alias("at_ms"), F.round("score", 4).alias("score"), "indicator", F.round("sub_score", 4).alias("sub_score"), "sub_rating")


@query("landed_panel", "SRC-21", compose("""SELECT instrument, COUNT(*) AS bars, MIN(session) AS first_session, MAX(session) AS last_session, ROUND(SUM(close), 4) AS total FROM (
 SELECT 'K' || (ticker % 8) AS instrument, session, CAST(SUM(ext) AS DOUBLE) / 100e0 AS close FROM trades WHERE ticker % 8 <> 5 OR year(session) = 1995 GROUP BY 1, 2) WHERE day(session) % 13 <> 0 GROUP BY 1 HAVING COUNT(*) > 500"""))
def landed_panel(spark, sf_dir):
    """A wide CSV of closes, one column per instrument, with blanks, words and a short series that drops out."""
    k = F.col("ticker") % 8
    d = V.daily(spark, sf_dir).filter((k != 5) | (F.year("session") == 1995)).withColumn("instrument", F.concat(F.lit("K"), k.cast("string")))
    d = d.groupBy("session").pivot("instrument", [f"K{i}" for i in range(8)]).agg((F.sum("ext") / 100.0).cast("string"))
    blank = F.dayofmonth("session") % 13 == 0
    wide = d.select(F.col("session").cast("string").alias("session"), *[F.when(blank, "closed").otherwise(F.col(f"K{i}")).alias(f"K{i}") for i in range(8)])
    path = f"{_folder(spark)}/panel"
    wide.write.option("header", True).csv(path)
    long = RD.read_price_panel(spark, path)
    return long.groupBy("instrument").agg(F.count("*").alias("bars"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.round(F.sum("close"), 4).alias("total"))


@query("landed_statements", "SRC-6", compose("""SELECT 'T' || ticker AS ticker, period_end, fact, ROUND(value, 2) AS value FROM (
 SELECT ticker, period_end, 'revenue' AS fact, revenue AS value FROM annual UNION ALL SELECT ticker, period_end, 'net_income', net_income FROM annual UNION ALL SELECT ticker, period_end, 'total_assets', total_assets FROM annual)"""))
def landed_statements(spark, sf_dir):
    """Statement tables with one column per fiscal date, a label nobody knows and a column that is no date."""
    a = V.annual(spark, sf_dir).select(F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker"), F.col("period_end").cast("string").alias("p"), "revenue", "net_income", "total_assets")
    labels = {"Total Revenue": "revenue", "Net Income": "net_income", "Total Assets": "total_assets", "Colour": "revenue"}
    items = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("v")) for n, c in labels.items()])
    years = [f"{y}-12-31" for y in range(1990, 2003)]
    wide = a.select("ticker", "p", F.explode(items).alias("i")).groupBy("ticker", F.lit("income").alias("statement"), F.col("i.label").alias("label")).pivot("p", years).agg(F.max("i.v")).withColumn("TTM", F.lit(1.0))
    path = f"{_folder(spark)}/statements"
    wide.write.parquet(path)
    return RD.read_statements(spark, path).filter("value IS NOT NULL").select("ticker", "period_end", "fact", F.round("value", 2).alias("value"))
