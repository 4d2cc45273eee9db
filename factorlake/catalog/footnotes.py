"""Footnote payloads of any shape: landed as text, stored as VARIANT by kind, walked and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import variants as VA
from ..operators import risk as K
from ..session import stable
from ..sources import driver_views as V, readers as RD, sinks as SK
from .registry import query
from .sqlviews import compose
from .streams import _folder

YEAR = 2001


def _nest(body, depth):
    """JSON text of an object ``depth`` levels down, in objects and lists by turns."""
    return F.concat(F.repeat(F.lit('{"w":[0,null,'), depth), body, F.repeat(F.lit("]}"), depth))


def _blocks(newest, older):
    """A period-major payload, the newest block last."""
    return F.concat(F.lit('{"periods":['), older, F.lit(","), newest, F.lit("]}"))


def _fact(name: str, value):
    return F.to_json(F.named_struct(F.lit(name), value))


def _shares(spark, sf_dir) -> DataFrame:
    """Yearly sales shares of three groups of buyer nations."""
    c = V.customer_shares(spark, sf_dir).join(F.broadcast(V.read(spark, sf_dir, "nation").select(F.col("n_name").alias("party"), "n_nationkey")), "party")  # 25 nations
    return c.groupBy("ticker", "period_end", (F.col("n_nationkey") % 3).alias("g")).agg(F.sum("share").alias("share"), F.sum("value").alias("value"), F.max("total").alias("total"))


def landed(spark, sf_dir) -> DataFrame:
    """(ticker, kind, payload): text payloads whose figures come from statements and sales of each filer.

    Figures stand one to six levels deep, in the newest or an older block, dated or not, listed or loose.
    """
    k = F.col("ticker")
    depth = (k % 6).cast("int") + 1
    a = V.annual(spark, sf_dir)
    last = a.groupBy("ticker").agg(F.max_by(F.struct("period_end", "total_debt", "current_liabilities", "total_assets", "cash", "current_assets", "stock_comp", "net_income", "capex"), "period_end").alias("a")).select("ticker", "a.*")
    year = F.year("period_end")
    block = lambda body: F.concat(F.lit('{"fiscalYear":'), year, F.lit(',"x":'), body, F.lit("}"))
    old = lambda body: F.concat(F.lit('{"fiscalYear":'), year - 1, F.lit(',"x":'), body, F.lit("}"))
    debt = lambda due, amount: F.to_json(F.struct(due.alias("dueYear"), amount.alias("principal")))
    near, far = debt(F.lit(YEAR + 2), F.col("current_liabilities")), debt(F.lit(YEAR + 9), F.col("total_debt") * 3)
    loose = F.concat(F.lit('{"a":'), _nest(near, depth), F.lit(',"b":'), _nest(far, depth + 1), F.lit("}"))
    listed = F.concat(F.lit('{"tranches":['), near, F.lit(","), far, F.lit(',{"dueYear":"none"}],"note":'), _nest(debt(F.lit(YEAR), F.lit(1e12)), depth), F.lit("}"))
    drawn = F.col("cash") / F.col("current_assets") * 2
    usage = _nest(_fact("utilization", F.when(k % 5 == 0, drawn * 100).otherwise(drawn)), depth)
    kinds = {
        # a third is listed, a third loose in the newest block, a third loose in an older one
        "debt-structure": F.when(k % 3 == 0, F.concat(F.lit("["), listed, F.lit("]"))).when(k % 3 == 1, _blocks(block(loose), old(F.lit("{}")))).otherwise(_blocks(block(F.lit("1")), old(loose))),
        "credit-facilities": F.when(k % 2 == 0, _blocks(block(_fact("utilization", F.lit(0.1))), old(usage))).otherwise(_blocks(block(usage), old(F.lit("{}")))),
        "stock-compensation": _blocks(block(_nest(_fact("totalUnrecognizedCost", F.col("stock_comp") * 150), depth)), old(_fact("unrecognizedCost", F.lit(1e15)))),
        "retirement-plans": _blocks(block(F.concat(F.lit("["), _nest(_fact("fundedStatus", F.col("net_income")), depth), F.lit(","), _fact("fundedStatus", -F.col("capex")), F.lit("]"))), old(_fact("fundedStatus", F.lit(-1e15)))),
        "supplier-finance": _blocks(block(F.concat(F.lit('{"settledObligations":1e15,"in":'), _nest(_fact("outstandingBalance", F.col("capex") * 2), depth), F.lit("}"))), old(F.lit("{}"))),
        "fair-value-hierarchy": _blocks(block(_nest(_fact("level3Share", F.col("cash") / F.col("total_assets") * F.when(k % 2 == 0, 100).otherwise(1) * 4), depth)), old(_fact("level3Share", F.lit(0.99)))),
    }
    rows = last.select("ticker", F.explode(F.create_map(*[x for n, p in kinds.items() for x in (F.lit(n), p)])).alias("kind", "payload"))
    shares = stable(_shares(spark, sf_dir))  # read three times; trades, orders and customers meet once
    return rows.unionByName(_concentration(shares)).unionByName(_segments(shares)).unionByName(rows.filter(k % 10 == 0).select("ticker", "kind", F.lit("{broken").alias("payload")))


def _concentration(shares: DataFrame) -> DataFrame:
    """Histories with dates, without dates (newest first), and with one undated point beside dated ones."""
    mode = F.col("ticker") % 3
    period = F.when(mode != 1, F.col("period_end").cast("string"))
    points = F.array_sort(F.collect_list(F.struct(F.when(mode == 1, -F.year("period_end")).otherwise(F.year("period_end")).alias("o"), period.alias("period"), "share")))
    h = shares.groupBy("ticker", "g").agg(F.transform(points, lambda p: F.struct(p["period"].alias("period"), p["share"].alias("share"))).alias("history"))
    h = h.withColumn("history", F.when(mode == 2, F.concat("history", F.array(F.struct(F.lit(None).cast("string").alias("period"), F.lit(0.97).alias("share"))))).otherwise(F.col("history")))
    p = h.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("g", "history"))).alias("p"))
    parties = F.transform("p", lambda x: F.struct(F.concat(F.lit("Buyer "), x["g"].cast("string")).alias("name"), x["history"].alias("history")))
    return p.select("ticker", F.lit("concentration").alias("kind"), F.to_json(F.struct(F.array(F.struct(F.lit("customer").alias("riskType"), parties.alias("counterparties"))).alias("series"))).alias("payload"))


def _segments(s: DataFrame) -> DataFrame:
    """Geography by four ways of telling it, products with a line above revenue, segments with an elimination."""
    k = F.col("ticker")
    newest = s.groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    v = s.join(newest, ["ticker", "period_end"]).groupBy("ticker", "period_end").agg(*[(F.coalesce(F.sum(F.when(F.col("g") == g, F.col("value"))), F.lit(0)) / 100.0).alias(f"v{g}") for g in range(3)], (F.max("total") / 100.0).alias("total"))
    home, rest = F.col("v0") + F.col("v1"), F.col("v2")
    line = lambda name, value, **more: F.struct(F.lit(name).alias("name"), value.alias("value"), *[x.alias(n) for n, x in more.items()])
    text = lambda **parts: F.to_json(F.struct(*[F.array(*p).alias(n) for n, p in parts.items()]))
    at = lambda c: F.lit(c)
    country = line("Home", home, continent=at("X"))
    geo = (F.when(k % 4 == 0, text(countries=[country, line("Away", rest, continent=at("Y"))]))
           .when(k % 4 == 1, text(countries=[country]))
           .when(k % 4 == 2, text(countries=[country], regions=[line("Rest", rest, continent=F.lit(None).cast("string")), line("X land", home, continent=at("X"))], usStates=[line("State", home)]))
           .otherwise(text(countries=[country], regions=[F.struct(F.lit("World").alias("code"), F.col("total").alias("revenue"), home.alias("explainedByCountries"))], residuals=[line("none", F.lit(-5.0))])))
    lines = [F.struct(F.lit("Gross").alias("name"), (F.col("total") * 1.83).alias("value")), F.struct(F.lit("Goods").alias("name"), F.col("v0").alias("value")), F.struct(F.lit("Services").alias("name"), F.col("v1").alias("value"))]
    metric = lambda name, value, role="segment": F.struct(F.lit(name).alias("member"), F.lit(role).alias("role"), F.struct(value.alias("revenue")).alias("metrics"))
    year = F.year("period_end")
    revenue = F.concat(F.lit('{"data":[{"fiscalYear":'), year, F.lit(',"geography":'), geo, F.lit(',"product":'), F.to_json(F.array(*lines)), F.lit('},{"fiscalYear":'), year - 1, F.lit(',"geography":{}}]}'))
    business = F.concat(F.lit('[{"fiscalYear":'), year, F.lit(',"segments":'), F.to_json(F.array(metric("Core", home), metric("Side", rest), metric("Elimination", home * 9, "elimination"))), F.lit("}]"))
    kinds = F.create_map(F.lit("revenue-segmentation"), revenue, F.lit("business-segmentation"), business)
    return v.select("ticker", F.explode(kinds).alias("kind", "payload"))


def lake(spark, sf_dir) -> DataFrame:
    """Payload text landed as files, parsed once and stored by kind."""
    folder = _folder(spark)
    landed(spark, sf_dir).write.json(f"{folder}/landed")
    SK.save_footnotes(RD.read_footnotes(spark, f"{folder}/landed"), f"{folder}/lake")
    return RD.footnote_lake(spark, f"{folder}/lake")


def _filers(spark, sf_dir) -> DataFrame:
    """Market cap (unknown for every eighth) and the newest year's own revenue."""
    a = V.annual(spark, sf_dir)
    return a.groupBy("ticker").agg(F.when(F.col("ticker") % 8 != 7, F.max_by("total_assets", "period_end")).alias("market_cap"), F.max_by("revenue", "period_end").alias("revenue"))


_usd = lambda x: f"CASE WHEN ABS({x}) >= 1e9 THEN printf('$%.1fB', ({x}) / 1e9) WHEN ABS({x}) >= 1e6 THEN printf('$%.0fM', ({x}) / 1e6) ELSE '$' || format('{{:,}}', CAST(ROUND({x}) AS BIGINT)) END"
_pct = lambda x: f"printf('%.0f%%', ({x}) * 100e0)"
_FT = {
    "f": "SELECT *, 2003 AS horizon, CASE WHEN ticker % 8 <> 7 THEN total_assets END AS cap FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS k FROM annual) WHERE k = 1",
    "g": """SELECT c.ticker, period_end, n_nationkey % 3 AS g, SUM(share) AS share, CAST(SUM(value) AS BIGINT) AS value, CAST(MAX(total) AS BIGINT) AS total FROM customer_shares c JOIN nation ON n_name = party GROUP BY 1, 2, 3""",
    # one undated point of the third mode never counts; without dates the places count, and they run backwards
    "hist": """SELECT ticker, g, CASE WHEN ticker % 3 = 1 THEN MIN_BY(share, period_end) ELSE MAX_BY(share, period_end) END AS latest,
 CASE WHEN COUNT(*) > 1 THEN CASE WHEN ticker % 3 = 1 THEN MAX_BY(share, period_end) ELSE MIN_BY(share, period_end) END END AS earliest FROM g GROUP BY ticker, g""",
    "buyer": "SELECT * FROM hist QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY latest DESC, g) = 1",
    "d": """SELECT ticker, current_liabilities AS near, current_liabilities + total_debt * 3 AS face, cash / current_assets * 2 AS u0, stock_comp * 150 AS comp, -(LEAST(0, net_income) + LEAST(0, -capex)) AS under, capex * 2 AS owed, cash / total_assets * CASE WHEN ticker % 2 = 0 THEN 100 ELSE 1 END * 4 AS l0, cap FROM f""",
    "e": """SELECT *, CASE WHEN ticker % 5 = 0 THEN u0 * 100 ELSE u0 END AS u1 FROM d""",
    "h": """SELECT *, GREATEST(CASE WHEN u1 > 1.5 AND u1 <= 100 THEN u1 / 100e0 ELSE u1 END, CASE WHEN ticker % 2 = 0 THEN 0.1e0 END) AS peak, CASE WHEN l0 > 1.5 AND l0 <= 100 THEN l0 / 100e0 ELSE l0 END AS level3 FROM e""",
}


@query("footnote_signals", "RSK-2 RSK-3 RSK-4 RSK-5 RSK-6 RSK-7 RSK-8 SRC-16 SCL-A2 SCL-A3 SCL-M9 WIN-26 WIN-27 EXT-5", compose(f"""
 SELECT ticker, CASE WHEN latest >= 0.30e0 THEN 'medium' ELSE 'info' END AS severity, 'Key-customer concentration' AS label, 'Buyer ' || g || ' at ' || {_pct('latest')} || ' of revenue' ||
  CASE WHEN ABS(latest - earliest) >= 0.02e0 THEN ' (' || {_pct('earliest')} || ' → ' || {_pct('latest')} || ' over the disclosed history)' ELSE '' END AS detail FROM buyer WHERE latest >= 0.15e0
 UNION ALL SELECT ticker, 'medium', 'Debt maturity wall', {_usd('near')} || ' of ' || {_usd('face')} || ' face amount (' || {_pct('near / face')} || ') matures by 2003' FROM h WHERE near > 0 AND near / face >= 0.25e0
 UNION ALL SELECT ticker, CASE WHEN peak >= 0.75e0 THEN 'medium' ELSE 'info' END, CASE WHEN peak >= 0.75e0 THEN 'Credit facilities heavily drawn' ELSE 'High credit-line utilization' END,
  'peak utilization ' || {_pct('peak')} || ' of committed capacity' || CASE WHEN peak >= 0.75e0 THEN ' across the disclosed facilities' ELSE '' END FROM h WHERE peak >= 0.5e0
 UNION ALL SELECT ticker, CASE WHEN comp / cap >= 0.15e0 THEN 'medium' ELSE 'info' END, 'Unvested equity compensation', {_usd('comp')} || ' of unrecognized equity compensation cost' || CASE WHEN cap <> 0 THEN ' (' || {_pct('comp / cap')} || ' of market cap)' ELSE '' END || ' — future expense and dilution'
  FROM h WHERE comp > 0 AND (cap IS NULL OR comp / cap >= 0.05e0)
 UNION ALL SELECT ticker, CASE WHEN under / cap >= 0.05e0 THEN 'medium' ELSE 'info' END, 'Underfunded pension plans', {_usd('under')} || ' net underfunded across the disclosed plans' || CASE WHEN cap <> 0 THEN ' (' || {_pct('under / cap')} || ' of market cap)' ELSE '' END FROM h WHERE under > 0
 UNION ALL SELECT ticker, CASE WHEN owed / cap >= 0.15e0 THEN 'medium' ELSE 'info' END, 'Supplier-finance obligations', {_usd('owed')} || ' outstanding under supplier-finance programs (reverse factoring — leverage parked in accounts payable)' ||
  CASE WHEN cap <> 0 THEN ' — ' || {_pct('owed / cap')} || ' of market cap' ELSE '' END FROM h WHERE owed > 0 AND (cap IS NULL OR owed / cap >= 0.02e0)
 UNION ALL SELECT ticker, 'info', 'Opaque Level 3 valuations', {_pct('level3')} || ' of recurring fair-value measurements rely on unobservable (model) inputs' FROM h WHERE level3 >= 0.30e0""", **_FT))
def footnote_signals(spark, sf_dir):
    d, filers = lake(spark, sf_dir), stable(_filers(spark, sf_dir))
    found = K.concentration_signals(K.concentration_table(d)).unionByName(K.fact_signals(K.footnote_facts(d, F.lit(YEAR)), filers, F.lit(YEAR)))
    return found.select("ticker", "severity", "label", "detail")


_SEG = {
    "newest": "SELECT ticker, MAX(period_end) AS period_end FROM g GROUP BY 1",
    "v": "SELECT g.ticker, COALESCE(SUM(CASE WHEN g = 0 THEN value END), 0) / 100e0 AS v0, COALESCE(SUM(CASE WHEN g = 1 THEN value END), 0) / 100e0 AS v1, COALESCE(SUM(CASE WHEN g = 2 THEN value END), 0) / 100e0 AS v2 FROM g JOIN newest n ON n.ticker = g.ticker AND n.period_end = g.period_end GROUP BY 1",
    "r": "SELECT v.*, f.revenue, CASE ticker % 4 WHEN 0 THEN 'Away' WHEN 2 THEN 'Rest' WHEN 3 THEN 'World' END AS other FROM v JOIN f USING (ticker)",
    "leaf": "SELECT ticker, 'Home' AS party, v0 + v1 AS value, revenue FROM r UNION ALL SELECT ticker, other, v2, revenue FROM r WHERE other IS NOT NULL AND v2 > 0",
    "leaves": "SELECT *, SUM(value) OVER (PARTITION BY ticker) AS total FROM leaf QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY value DESC, party DESC) = 1",
}


@query("segmentation_signals", "RSK-9 RSK-10 RSK-11 TOP-7 SRC-16", compose(f"""
 SELECT ticker, 'Geographic revenue concentration' AS label, {_pct('value / total')} || ' of revenue from ' || party AS detail FROM leaves WHERE total / revenue BETWEEN 0.90e0 AND 1.10e0 AND value / total >= 0.60e0
 UNION ALL SELECT ticker, 'Product revenue concentration', {_pct('GREATEST(v0, v1) / revenue')} || ' of revenue from ' || CASE WHEN v1 >= v0 THEN 'Services' ELSE 'Goods' END FROM r WHERE GREATEST(v0, v1) / revenue >= 0.40e0
 UNION ALL SELECT ticker, 'Segment revenue concentration', {_pct('GREATEST(v0 + v1, v2) / (v0 + v1 + v2)')} || ' of revenue from the ' || CASE WHEN v2 >= v0 + v1 THEN 'Side' ELSE 'Core' END || ' segment' FROM r WHERE v2 > 0 AND v0 + v1 > 0 AND GREATEST(v0 + v1, v2) / (v0 + v1 + v2) >= 0.60e0""", **_FT, **_SEG))
def segmentation_signals(spark, sf_dir):
    """A map that misses a group of countries does not reconcile with the filer's own revenue and stays silent."""
    return K.segmentation_signals(lake(spark, sf_dir), _filers(spark, sf_dir)).select("ticker", "label", "detail")


@query("broken_footnotes", "SRC-16", compose("SELECT kind, COUNT(*) AS payloads, COUNT(*) FILTER (ticker % 10 = 0 AND copy = 1) AS broken FROM (SELECT ticker, UNNEST(['debt-structure', 'credit-facilities', 'stock-compensation', 'retirement-plans', 'supplier-finance', 'fair-value-hierarchy']) AS kind, UNNEST([0, 0, 0, 0, 0, 0]) AS copy FROM f UNION ALL SELECT ticker, UNNEST(['debt-structure', 'credit-facilities', 'stock-compensation', 'retirement-plans', 'supplier-finance', 'fair-value-hierarchy']), 1 FROM f WHERE ticker % 10 = 0) GROUP BY 1", **_FT))
def broken_footnotes(spark, sf_dir):
    """Payloads that are no JSON are kept and counted."""
    d = lake(spark, sf_dir).filter(F.col("kind").isin(K.WALKED))
    return d.groupBy("kind").agg(F.count("*").alias("payloads"), F.count("broken").alias("broken"))


@query("json_leaves", "SCL-A2 EXT-5", """SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events
 UNION ALL SELECT event_id, 'deep', CAST(value AS VARCHAR) FROM (SELECT event_id, CAST(ROUND(value * 100) AS BIGINT) AS value, UNNEST(range(CAST(event_id % 4 AS BIGINT))) FROM events) UNION ALL SELECT event_id, 'type', event_type FROM events""")
def json_leaves(spark, sf_dir):
    """Scalars at every depth: the event's own payload inside lists and objects of up to four levels."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    deep = F.concat(F.lit('{"deep":'), cents, F.lit(',"in":['))
    n = (F.col("event_id") % 4).cast("int")
    body = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","none":null,"props":'), F.col("props"), F.lit("}"))
    e = V.read(spark, sf_dir, "events").select("event_id", F.try_parse_json(F.concat(F.repeat(deep, n), body, F.repeat(F.lit("]}"), n))).alias("v"))
    return VA.scalars(VA.object_nodes(e, "v", ["event_id"]), ["event_id"])
