"""Market-shaped views over the star-schema tables.

A supplier plays the asset, its shipments the trades.  Money is summed as BIGINT cents so that no
result depends on the order of summation.  The trades are first combined per (ticker, day), with
map-side combine, so a supplier that holds a third of all rows never reaches a single task with its
raw rows: after that step a ticker has at most one row per calendar day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder, stable
from .sinks import save_by_ticker

#: Bars that smooth one close, filing delay, report delay.
SMOOTH_BARS = 60
FILING_BASE_DAYS = 45
REPORT_DELAY_DAYS = 30

#: Standard sector names in the provider's taxonomy.
SECTORS = ["Information Technology", "Consumer Discretionary", "Consumer Staples", "Health Care",
           "Financials", "Materials", "Energy", "Utilities", "Real Estate", "Industrials",
           "Communication Services"]


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table with its schema looked up once: a plan reads lineitem several times."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with the measures the views need (unused ones are pruned)."""
    ext = cents("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("session"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        ext.alias("ext"), F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc_pct"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax_pct"),
    )


def _smoothed(bars: DataFrame, key: str) -> DataFrame:
    """Close = traded value over traded quantity of the last 60 bars, as differences of exact running sums."""
    w = Window.partitionBy(key).orderBy("session")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumns({"bar_no": F.row_number().over(w), "_e": F.sum("ext").over(so_far), "_q": F.sum("qty").over(so_far)})

    def trailing(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, SMOOTH_BARS).over(w), F.lit(0))
    return (d.withColumn("close", trailing("_e") / (trailing("_q") * 100))
            .filter(F.col("bar_no") >= SMOOTH_BARS)
            .select(key, "session", "close"))


_DAILY: dict[tuple, str] = {}
#: A bucket of the daily table comes from about so many bytes of trades; more buckets than this are never made.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 20_000
#: A ticker with more trades than this is summed per day before it moves.
HOT_TRADES = 4_000_000


def _stamp(spark: SparkSession, path: str) -> int:
    """When the table last changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (ticker, day) with every sum the views need, bucketed by ticker.

    Written once per data set and session, in one pass over the trades: all later windows, groupings and
    joins on the ticker read it without an exchange. A changed table is summed anew.
    """
    source = read(spark, sf_dir, "lineitem")
    path = f"{sf_dir}/lineitem.parquet"
    key = (spark.sparkContext.applicationId, path, _stamp(spark, path))
    if key not in _DAILY or not spark.catalog.tableExists(_DAILY[key]):
        size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, size // BUCKET_BYTES))
        name = f"daily_{uuid.uuid4().hex}"
        days = _daily_sums(_marked(trades(spark, sf_dir)), buckets)
        save_by_ticker(days, name, f"{shared_folder(spark)}/{name}", buckets, ["session"])
        _DAILY[key] = name
    return spark.table(_DAILY[key])


#: What a trade counts for, as bits of one small number.
MARKS = {"kept": 1, "a": 2, "n": 4, "open": 8, "paid": 16}


def _marked(t: DataFrame) -> DataFrame:
    """The columns of the trades that the daily sums need, as narrow as they go: this is what is shuffled."""
    flag = F.col("flag")
    tests = {"kept": flag != "R", "a": flag == "A", "n": flag == "N", "open": F.col("status") == "O", "paid": (flag == "N") & (F.col("line") == 1)}
    bits = sum((F.when(test, MARKS[name]).otherwise(0) for name, test in tests.items()), F.lit(0))
    return t.select("ticker", "session", "ext", "qty", "disc_pct", "tax_pct", bits.alias("marks"))


def _daily_sums(t: DataFrame, buckets: int) -> DataFrame:
    """Sums per (ticker, day). Trades move once, by ticker, as the table is stored.

    A ticker has about as many days as trades here, so summing before the shuffle would only widen the rows. Only where
    a hot ticker would put its trades into one task are they summed first, spread by (ticker, day).
    """
    ext = F.col("ext")

    def has(mark: str) -> Column:
        return F.col("marks").bitwiseAND(F.lit(MARKS[mark])) != 0

    def part(mark: str) -> Column:
        return F.sum(F.when(has(mark), ext).otherwise(0)).alias(mark)
    hot = t.groupBy("ticker").count().where(F.col("count") > HOT_TRADES).limit(1)
    spread = t if not hot.isEmpty() else t.repartition(buckets, "ticker")
    return spread.groupBy("ticker", "session").agg(
        F.sum(ext).alias("ext"), F.sum("qty").alias("qty"), F.sum(ext * F.col("disc_pct")).alias("disc"), F.sum(ext * F.col("tax_pct")).alias("tax"),
        part("kept"), part("a"), part("n"), part("open"), F.count_if(has("paid")).alias("payments"), F.sum(F.when(has("paid"), F.col("disc_pct")).otherwise(0)).alias("paid_pct"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(daily(spark, sf_dir), "ticker")


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assets together: one row per day, so the one-key window is bounded by the calendar."""
    bars = (daily(spark, sf_dir).groupBy("session").agg(F.sum("ext").alias("ext"), F.sum("qty").alias("qty"))
            .withColumn("symbol", F.lit("MARKET")))
    return _smoothed(bars, "symbol")


def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last session per asset: no window needed."""
    return daily(spark, sf_dir).groupBy("ticker").agg(F.max("session").alias("session"))


def _period_sums(days: DataFrame, period_end: Column) -> DataFrame:
    named = {"ext": "s_ext", "qty": "s_qty", "disc": "s_disc", "tax": "s_tax", "kept": "s_kept", "a": "s_a", "n": "s_n", "open": "s_open"}
    half = F.sum(F.when(F.month("session") >= 7, F.col("ext")).otherwise(0)).alias("s_half2")
    return days.groupBy("ticker", period_end.alias("period_end")).agg(*[F.sum(c).alias(out) for c, out in named.items()], half)


#: Long-form layout of the statement facts: statement -> fact columns.
STATEMENTS = {
    "income": ["revenue", "gross_profit", "net_income", "ebit", "ebitda", "interest_expense",
               "income_tax", "pretax_income"],
    "balance": ["shares", "total_assets", "equity", "total_debt", "current_assets",
                "current_liabilities", "total_liabilities", "retained_earnings", "cash"],
    "cash": ["ocf", "fcf", "capex", "stock_comp"],
}
FACTS = [f for names in STATEMENTS.values() for f in names]


def _with_facts(sums: DataFrame, acctbal: DataFrame) -> DataFrame:
    d = sums.join(acctbal, "ticker")
    def q(expr: str) -> Column:
        return F.expr(expr)
    return (d
            .withColumn("revenue", F.col("s_ext"))
            .withColumn("gross_profit", q("s_ext - s_disc div 100 - s_tax div 100 - (4 * s_ext) div 10"))
            .withColumn("net_income", q("s_kept - s_disc div 100 - (6 * s_ext) div 10"))
            .withColumn("ebit", q("net_income + s_tax div 100"))
            .withColumn("ebitda", q("ebit + s_disc div 500"))
            .withColumn("interest_expense", q("s_disc div 1000"))
            .withColumn("income_tax", q("greatest(net_income, 0L) div 4"))
            .withColumn("pretax_income", q("net_income + income_tax"))
            .withColumn("shares", F.col("s_qty"))
            .withColumn("total_assets", q("s_ext + s_open"))
            .withColumn("equity", q("s_ext div 10 + 2000 * acct_cents"))
            .withColumn("total_debt", F.col("s_a"))
            .withColumn("current_assets", F.col("s_half2"))
            .withColumn("current_liabilities", q("(9 * s_n) div 10"))
            .withColumn("total_liabilities", q("total_assets - equity"))
            .withColumn("retained_earnings", q("CAST(FLOOR(equity / 2.0D) AS BIGINT)"))
            .withColumn("cash", q("s_half2 div 3"))
            .withColumn("ocf", q("s_kept - (65 * s_ext) div 100"))
            .withColumn("capex", q("s_tax div 100"))
            .withColumn("fcf", q("ocf - capex"))
            .withColumn("stock_comp", q("s_disc div 2000")))


def _acctbal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ticker"), cents("s_acctbal").alias("acct_cents"))


def annual_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal-year facts in cents, one wide row per ticker and year, with its filing day."""
    sums = _period_sums(daily(spark, sf_dir), F.make_date(F.year("session"), F.lit(12), F.lit(31)))
    facts = _with_facts(sums, _acctbal(spark, sf_dir))
    filed = F.date_add("period_end", (F.lit(FILING_BASE_DAYS) + F.col("ticker") % 60).cast("int"))
    return facts.select("ticker", "period_end", filed.alias("date_filed"), *FACTS)


def quarterly_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _period_sums(daily(spark, sf_dir), F.last_day(F.add_months(F.trunc("session", "quarter"), 2)))
    facts = _with_facts(sums, _acctbal(spark, sf_dir))
    return facts.select("ticker", "period_end", *FACTS)


def in_currency(facts: DataFrame) -> DataFrame:
    """Cents to currency units as doubles; per-share earnings on top."""
    money = [f for f in FACTS if f != "shares"]
    kept = [c for c in facts.columns if c not in FACTS]
    return facts.select(
        *kept, F.col("shares").cast("double").alias("shares"), *[(F.col(f) / 100.0).alias(f) for f in money],
        F.try_divide(F.col("net_income") / 100.0, F.col("shares").cast("double")).alias("eps"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_currency(annual_cents(spark, sf_dir))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_currency(quarterly_cents(spark, sf_dir))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount in currency, one row per ticker and ex-date."""
    return daily(spark, sf_dir).filter("payments > 0").select("ticker", F.col("session").alias("ex_date"), (F.col("paid_pct").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("amount"))


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter_end = F.last_day(F.add_months(F.trunc("session", "quarter"), 2)).alias("quarter_end")
    per_quarter = daily(spark, sf_dir).groupBy("ticker", quarter_end).agg(F.sum("ext").alias("eps_reported"))
    w = Window.partitionBy("ticker").orderBy("quarter_end")
    est = F.lag("eps_reported").over(w)
    rep = F.col("eps_reported")
    surprise = F.try_divide((rep - est).cast("double"), F.abs(est).cast("double")) * 100.0
    return (per_quarter.withColumn("eps_estimate", est)
            .withColumn("surprise_pct", surprise)
            .select("ticker", F.date_add("quarter_end", REPORT_DELAY_DAYS).alias("reported_at"),
                    "eps_estimate", "eps_reported", "surprise_pct"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive fields of an asset.  nation and region are 25 and 5 fixed rows: broadcast."""
    nation = read(spark, sf_dir, "nation").join(F.broadcast(
        read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    region = F.col("r_name")
    currency = (F.when(region == "AMERICA", "USD").when(region == "EUROPE", "EUR")
                .when(region == "ASIA", "JPY").when(region == "AFRICA", "GBP"))
    suffix = (F.when(region == "AMERICA", "").when(region == "EUROPE", ".DE")
              .when(region == "ASIA", ".T").when(region == "AFRICA", ".L").otherwise(".AX"))
    sectors = F.array(*[F.lit(s) for s in SECTORS])
    return read(spark, sf_dir, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("ticker"), F.concat(F.lit("T"), k.cast("string"), suffix).alias("symbol"),
        F.col("s_name").alias("name"), F.when(k % 5 == 0, "ETF").otherwise("STOCK").alias("asset_type"),
        F.col("n_name").alias("nation"), region.alias("region"), currency.alias("currency"),
        F.get(sectors, (F.col("s_nationkey") % len(SECTORS)).cast("int")).alias("sector"),
        F.when(k % 5 == 0, (k * 7 % 160) / 100.0).alias("expense_ratio"),
        F.when(k % 5 == 0, (k * 37 % 1000 + 1) * 250000000.0).alias("total_assets"),
        F.when(k % 5 == 0, (k * 13 % 300) / 100.0).alias("beta_3y"),
        F.when(k % 5 == 0, (k * 17 % 40 - 10) / 100.0).alias("three_year_return"),
        F.when(k % 5 == 0, (k * 11 % 30 - 8) / 100.0).alias("five_year_return"),
        F.when(k % 5 == 0, (k * 3 % 6) / 100.0).alias("fund_yield"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset pools: one per region, plus one that overlaps them all."""
    p = profiles(spark, sf_dir)
    cls = F.when(F.col("asset_type") == "ETF", "etfs").otherwise("stocks")
    region = (F.when(F.col("region") == "AMERICA", "us").when(F.col("region").isin("EUROPE", "AFRICA"), "eu")
              .otherwise("asia"))
    pool_no = F.when(region == "us", 1).when(region == "eu", 2).otherwise(3)
    regional = p.select(
        F.when(cls == "etfs", pool_no + 4).otherwise(pool_no).alias("pool"), cls.alias("asset_class"),
        region.alias("region"), F.col("ticker").alias("ord"), F.concat(F.lit("T"), F.col("ticker").cast("string")).alias("ticker"))
    consensus = (p.filter((F.col("ticker") % 3 == 0) & (F.col("asset_type") == "STOCK"))
                 .select(F.lit(4).alias("pool"), F.lit("stocks").alias("asset_class"),
                         F.lit("consensus").alias("region"), F.col("ticker").alias("ord"),
                         F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker")))
    return regional.unionByName(consensus)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").filter(k % 50 == 7).select(
        F.concat(F.lit("T"), k.cast("string")).alias("alias"),
        F.concat(F.lit("T"), (k - 1).cast("string")).alias("canonical"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manager weights in basis points of the manager's own total, each manager's newest quarter."""
    # an order has about one trade per asset: summing these first would only move the trades once more
    t = trades(spark, sf_dir).select("orderkey", "ticker", F.trunc("session", "quarter").alias("quarter"), "ext")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.col("o_custkey") % 82).alias("manager"))
    quarters = stable(t.join(o, "orderkey").groupBy("manager", "quarter", "ticker").agg(F.sum("ext").alias("ext")))
    # 82 managers: one row each says which quarter is the newest and what it adds up to
    per_quarter = quarters.groupBy("manager", "quarter").agg(F.sum("ext").alias("total"))
    newest = per_quarter.groupBy("manager").agg(F.max("quarter").alias("quarter"), F.max_by("total", "quarter").alias("total"))
    return quarters.join(newest, ["manager", "quarter"]).select(
        "manager", F.concat(F.lit("S."), F.col("ticker").cast("string")).alias("symbol"),
        F.expr("(ext * 10000) div total").alias("bps"))


def customer_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each buyer nation in an asset's yearly sales (25 parties at most)."""
    t = trades(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("party"))
    per = (t.join(o, "orderkey").join(c, "o_custkey")
           .groupBy("ticker", F.make_date(F.year("session"), F.lit(12), F.lit(31)).alias("period_end"), "c_nationkey")
           .agg(F.sum("ext").alias("value")))
    total = F.sum("value").over(Window.partitionBy("ticker", "period_end"))
    return (per.join(F.broadcast(n), "c_nationkey")
            .select("ticker", "period_end", "party", "value", total.alias("total"))
            .withColumn("share", F.col("value") / F.col("total")))


def product_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of an asset per fiscal year and part type."""
    t = trades(spark, sf_dir)
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("product"))
    return (t.join(p, "partkey")
            .groupBy("ticker", F.year("session").alias("fiscal_year"), "product").agg(F.sum("ext").alias("value")))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session"))
            .agg((F.sum(cents("value")) / (F.count("*") * 100)).alias("close")))
