"""Landing formats and sinks: derived payloads parsed back, tables written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N, payload as P, text as X
from ..operators import fundamentals as U
from ..sources import driver_views as V, readers as RD, sinks as SK
from .filings import _BALANCES, _FLOWS, _TTM
from .registry import query, rnd
from .sqlviews import compose, lin, nonneg, r
from .streams import _folder


@query("scalar_guards", "SCL-M1 SCL-M2 SCL-M3 SCL-M12 SCL-S6 SCL-M8 SCL-M9", f"""SELECT s_suppkey AS ticker, {r(lin('s_acctbal', 8000, -500))} AS score, {nonneg('s_acctbal')} AS non_negative, CAST(NULL AS DOUBLE) AS parsed_name, s_acctbal AS parsed_balance,
 CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE s_acctbal END AS first_known, CASE WHEN ABS(v) >= 1e9 THEN '$' || printf('%.1fB', v / 1e9) WHEN ABS(v) >= 1e6 THEN '$' || printf('%.0fM', v / 1e6) ELSE '$' || format('{{:,}}', CAST(ROUND(v) AS BIGINT)) END AS money,
 ROUND(CASE WHEN y > 1 THEN y / 100 ELSE y END, 6) + 0.0 AS yield, ROUND(CASE WHEN y > 1.5 AND y <= 100 THEN y / 100 ELSE y END, 6) + 0.0 AS share FROM (SELECT *, s_acctbal * 150000e0 AS v, (s_suppkey % 130) * 1e0 AS y FROM supplier)""")
def scalar_guards(spark, sf_dir):
    s = V.read(spark, sf_dir, "supplier")
    bal, k = F.col("s_acctbal"), F.col("s_suppkey")
    y = (k % 130).cast("double")
    return s.select(k.alias("ticker"), rnd(N.linear("s_acctbal", 8000, -500)).alias("score"), N.non_negative("s_acctbal").alias("non_negative"),
                    N.finite_number("s_name").alias("parsed_name"), N.finite_number(bal.cast("string")).alias("parsed_balance"),
                    N.first_known(F.when(k % 3 == 0, 0.0), bal).alias("first_known"), X.usd_text(bal * 150000.0).alias("money"),
                    rnd(N.sanitize_yield(y)).alias("yield"), rnd(N.share_norm(y)).alias("share"))


@query("quote_modules", "SRC-2 SRC-1", compose(
    f"SELECT ticker, UPPER(asset_type) AS quote_type, sector, currency, {r('CASE WHEN ticker % 2 = 0 THEN expense_ratio ELSE expense_ratio / 100e0 * 100e0 END')} AS annual_expense_ratio, total_assets, CASE WHEN ticker % 4 <> 0 THEN beta_3y END AS beta_3y FROM profiles"))
def quote_modules(spark, sf_dir):
    """Nested provider payloads: the expense ratio sits at two depths, some numbers are text that does not parse."""
    p = V.profiles(spark, sf_dir)
    k, er = F.col("ticker"), F.col("expense_ratio")
    bad = F.when(k % 4 == 0, "n/a").otherwise(F.col("beta_3y").cast("string"))
    modules = F.struct(
        F.struct("currency", F.col("total_assets").alias("totalAssets")).alias("summaryDetail"), F.struct(F.lower("asset_type").alias("quoteType")).alias("quoteType"),
        F.struct("sector").alias("summaryProfile"), F.struct(bad.alias("beta3Year")).alias("defaultKeyStatistics"),
        F.struct(F.when(k % 2 == 0, er).alias("annualReportExpenseRatio"), F.struct(F.when(k % 2 == 1, er / 100.0).alias("annualReportExpenseRatio")).alias("feesExpensesInvestment")).alias("fundProfile"))
    d = RD.flatten_quote_modules(p.select("ticker", F.to_json(modules).alias("modules")))
    return d.select("ticker", "quote_type", "sector", "currency", rnd("annual_expense_ratio").alias("annual_expense_ratio"), "total_assets", "beta_3y")


@query("ttm_payloads", "SRC-9 SCL-A5", compose(f"SELECT ticker, {r('revenue', 2)} AS revenue, {r('CASE WHEN ticker % 2 = 0 THEN net_income ELSE net_income + 1 END / revenue', 6)} AS net_margin FROM ttm", **_TTM))
def ttm_payloads(spark, sf_dir):
    """Trailing blocks, wrapped and bare, by symbol and by CIK; margins arrive as percent numbers."""
    t = U.ttm_facts(V.quarterly(spark, sf_dir), _FLOWS, _BALANCES)
    k = F.col("ticker")

    def facts(shift):
        ni = F.col("net_income") + shift
        return F.struct(F.col("revenue"), (ni / F.col("revenue") * 100.0).alias("netMargin"))
    even = t.filter(k % 2 == 0).select("ticker", F.lit("cik").alias("selector"), F.to_json(F.struct(facts(0.0).alias("facts"))).alias("payload"))
    odd = t.filter(k % 2 == 1)
    wrapped = odd.select("ticker", F.lit("symbol").alias("selector"), F.to_json(F.struct(F.array(F.struct(facts(1.0).alias("facts"))).alias("data"))).alias("payload"))
    other = odd.select("ticker", F.lit("cik").alias("selector"), F.to_json(F.array(F.struct(facts(9.0).alias("facts")))).alias("payload"))
    d = RD.ttm_block(even.unionByName(wrapped).unionByName(other)).withColumn("facts", P.percent_form(F.col("facts"), ["netMargin"]))
    return d.select("ticker", F.round(F.col("facts")["revenue"], 2).alias("revenue"), rnd(F.col("facts")["netMargin"]).alias("net_margin"))


@query("ticker_lines", "SRC-19 FLT-9", "SELECT 'T' || s_suppkey AS ticker, COUNT(*) AS times FROM supplier, (SELECT UNNEST([1, 2]) AS c) WHERE c = 1 OR s_suppkey % 2 = 0 GROUP BY 1")
def ticker_lines(spark, sf_dir):
    """Ticker list lines with mixed separators and comments."""
    k = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("  T"), k, F.lit(",\tT"), k, F.lit(" # again"))).otherwise(F.concat(F.lit("T"), k, F.lit("# T"), k))
    d = RD.parse_ticker_lines(V.read(spark, sf_dir, "supplier").select(line.alias("value")))
    return d.groupBy("ticker").agg(F.count("*").alias("times"))


@query("saved_periods", "SNK-4 SNK-5", compose(
    "SELECT ticker, COUNT(*) AS periods, MAX(date_filed) AS last_filed, ticker % 3 = 0 AS stitched FROM annual WHERE ticker % 3 <> 0 OR year(period_end) >= 1998 GROUP BY ticker"))
def saved_periods(spark, sf_dir):
    """A second batch replaces every third ticker; the others arrive empty and keep their stored periods."""
    a = V.annual_cents(spark, sf_dir).select("ticker", "period_end", "date_filed")
    path = f"{_folder(spark)}/periods"
    SK.save_periods(a.withColumn("stitched", F.lit(False)), path, buckets=8)
    SK.save_periods(a.filter((F.col("ticker") % 3 == 0) & (F.year("period_end") >= 1998)).withColumn("stitched", F.lit(True)), path, buckets=8)
    return SK.inventory(spark.read.parquet(path))


@query("tagged_metrics", "SNK-2 SNK-3 SNK-6", "SELECT n_name AS metric, n_regionkey * 1e0 AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, '5y' AS period FROM nation")
def tagged_metrics(spark, sf_dir):
    """Metrics written under two tags with their run configuration, read back together."""
    n = V.read(spark, sf_dir, "nation")
    path = f"{_folder(spark)}/metrics"
    for tag, rest in (("even", 0), ("odd", 1), ("even", 0)):
        SK.write_metrics(n.filter(F.col("n_nationkey") % 2 == rest).select(F.col("n_name").alias("metric"), F.col("n_regionkey").cast("double").alias("value")), path, tag, {"period": "5y"})
    d = spark.read.schema("metric string, value double, config map<string,string>, tag string").json(path)
    return d.select("metric", "value", "tag", F.col("config")["period"].alias("period"))


@query("adjusted_bars", "SRC-4", compose(
    "SELECT ticker, session, close * 0.5e0 * (close * f / close) AS open, close * 2e0 * (close * f / close) AS high, close * f AS close, CASE WHEN ticker % 4 = 0 THEN 0 ELSE ticker END AS volume FROM (SELECT *, CASE WHEN ticker % 3 = 0 THEN 1e0 ELSE 0.75e0 END AS f FROM prices) WHERE ticker % 7 <> 3"))
def adjusted_bars(spark, sf_dir):
    """Vendor bars as text with an adjusted close; some lack it, some assets are malformed and drop out."""
    p = V.prices(spark, sf_dir)
    k, c = F.col("ticker"), F.col("close")
    raw = p.select("ticker", F.col("session").cast("string").alias("date"), F.when(k % 7 != 3, (c * 0.5).cast("string")).alias("open"), (c * 2.0).cast("string").alias("high"),
                   (c * 0.4).cast("string").alias("low"), c.cast("string").alias("close"), F.when(k % 3 != 0, (c * 0.75).cast("string")).alias("adj_close"),
                   F.when(k % 4 != 0, k.cast("string")).otherwise("n/a").alias("volume"))
    d = RD.adjust_ohlc(raw)
    # no rounding: every value is the same sequence of exact double operations on both sides
    return d.select("ticker", "session", "open", "high", "close", "volume")
