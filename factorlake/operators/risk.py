"""Risk signals as a long table; context only, never part of a score.

Every rule yields rows (ticker, severity, label, detail, source).  Unknown shapes yield nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, variants as VA
from ..functions.numeric import ratio, share_norm
from ..session import stable
from .filters import severity_rank

# Alert thresholds.
DEBT_TO_EQUITY_ALERT, PAYOUT_ALERT, PAYOUT_WATCH = 200.0, 1.0, 0.85
CUSTOMER_ALERT, CUSTOMER_WATCH, SUPPLIER_WATCH, TREND_STEP = 0.30, 0.15, 0.30, 0.02
WALL_RATIO, WALL_YEARS = 0.25, 2
FACILITY_ALERT, FACILITY_WATCH = 0.75, 0.50
COMP_ALERT, COMP_WATCH, PENSION_ALERT, SUPPLIER_FINANCE_WATCH = 0.15, 0.05, 0.05, 0.02
LEVEL3_WATCH, COUNTRY_WATCH, PRODUCT_WATCH, SEGMENT_WATCH = 0.30, 0.60, 0.40, 0.60
RECONCILED = (0.90, 1.10)
FOOTNOTES = "footnotes"
# Wording of the report lines.
HEAVILY_DRAWN = " of committed capacity across the disclosed facilities"
DRAWN = " of committed capacity"
COMP_COST = " of unrecognized equity compensation cost"
COMP_END = " — future expense and dilution"
UNDERFUNDED = " net underfunded across the disclosed plans"
SUPPLIER_PROGRAMS = " outstanding under supplier-finance programs (reverse factoring — leverage parked in accounts payable)"
UNOBSERVABLE = " of recurring fair-value measurements rely on unobservable (model) inputs"


def _pct0(v: Column) -> Column:
    return X.percent_text(v, 0)


def signal(cond: Column, severity: Column | str, label: str, detail: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(cond, F.struct(sev.alias("severity"), F.lit(label).alias("label"), detail.alias("detail")))


def _emit(df: DataFrame, signals: list[Column], source: str, key: str = "ticker") -> DataFrame:
    d = df.select(key, F.posexplode(F.array_compact(F.array(*signals))).alias("pos", "s"))
    return d.select(key, "s.severity", "s.label", "s.detail", F.lit(source).alias("source"), F.col("pos"))


def ordered(signals: DataFrame, key: str = "ticker") -> DataFrame:
    """High, medium, info, the rest; emission order inside a severity."""
    return signals.orderBy(key, severity_rank(F.col("severity")), "source", "pos")


def local_signals(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Rules over features plus the ``pio`` and ``alt`` structs."""
    c = F.col
    z, zone = c("alt.z_score"), c("alt.zone")
    failed = lambda k: F.coalesce(~c(f"pio.{k}"), F.lit(False))
    payout = c("payout_ratio")
    return _emit(df, [
        signal(zone == "distress", "high", "Altman Z in distress zone", F.format_string("Z-Score %.2f (< 1.81)", z)),
        signal(zone == "grey", "medium", "Altman Z in grey zone", F.format_string("Z-Score %.2f (1.81-2.99)", z)),
        signal(c("profit_margin") < 0, "medium", "Loss-making", F.format_string("net margin %.1f%%", c("profit_margin") * 100.0)),
        signal(c("free_cashflow") < 0, "medium", "Negative free cash flow", F.format_string("FCF $%.1fB", c("free_cashflow") / 1e9)),
        signal(c("debt_to_equity") > DEBT_TO_EQUITY_ALERT, "medium", "High leverage", F.format_string("debt/equity %.0f%% (alert threshold 200%%)", c("debt_to_equity"))),
        signal(payout > PAYOUT_ALERT, "medium", "Dividend not covered by earnings", F.format_string("payout ratio %.0f%%", payout * 100.0)),
        signal((payout > PAYOUT_WATCH) & (payout <= PAYOUT_ALERT), "info", "High payout ratio", F.format_string("payout ratio %.0f%%", payout * 100.0)),
        signal(failed("accruals"), "medium", "Earnings quality (accruals)", F.lit("operating cash flow below reported net income")),
        signal(failed("margin_improving") & failed("roa_improving"), "medium", "Deteriorating fundamentals", F.lit("gross margin and ROA both lower than the previous fiscal year")),
        signal(failed("no_dilution"), "info", "Share dilution", F.lit("shares outstanding higher than the previous fiscal year")),
        signal(failed("leverage_decreasing"), "info", "Rising leverage", F.lit("debt/assets higher than the previous fiscal year")),
    ], "local", key)


# ---- table forms: one row per item -----------------------------------------------------------

def share_history(shares: DataFrame, key: str = "ticker") -> DataFrame:
    """Earliest and latest share per party, by date where any point has one, else by ``position``; a single point has no earliest.

    ``shares``: ticker, risk, party, period, share, and perhaps position (place in the payload) and entry
    (place of the party: parties of one name in several lists stay apart). Undated points never count beside dated ones.
    """
    place = F.col("position").cast("long") if "position" in shares.columns else F.lit(0).cast("long")
    d = shares.filter(F.col("share").isNotNull()).withColumn("_at", F.struct(F.col("period"), place))
    dated = F.col("period").isNotNull()
    known = F.when(dated, F.col("_at"))
    some = F.count_if(dated) > 0
    apart = ["entry"] if "entry" in shares.columns else []
    return d.groupBy(key, "risk", "party", *apart).agg(
        F.when(some, F.max_by("share", known)).otherwise(F.max_by("share", "_at")).alias("latest"),
        F.when(some, F.when(F.count_if(dated) > 1, F.min_by("share", known))).otherwise(F.when(F.count("*") > 1, F.min_by("share", "_at"))).alias("earliest"))



def concentration_signals(shares: DataFrame, key: str = "ticker", alert: float = CUSTOMER_ALERT, watch: float = CUSTOMER_WATCH,
                          supplier: float = SUPPLIER_WATCH) -> DataFrame:
    """Largest customer (or credit) and largest supplier, with the change over the disclosed history."""
    h = share_history(shares, key)
    kind = F.when(F.col("risk").contains("customer") | F.col("risk").contains("credit"), "customer").when(F.col("risk").contains("supplier"), "supplier")
    h = h.withColumn("kind", kind).filter("kind IS NOT NULL")
    tie = (-F.col("entry")) if "entry" in h.columns else F.col("party")
    top = h.groupBy(key, "kind").agg(F.max_by(F.struct("risk", "party", "latest", "earliest"), F.struct(F.col("latest"), tie)).alias("t")).select(key, "kind", "t.*")
    moved = F.coalesce(F.abs(F.col("latest") - F.col("earliest")) >= TREND_STEP, F.lit(False))
    trend = F.when(moved, F.concat(F.lit(" ("), _pct0(F.col("earliest")), F.lit(" → "), _pct0(F.col("latest")), F.lit(" over the disclosed history)"))).otherwise("")
    of = F.when(F.col("risk").contains("credit"), "receivables").otherwise("revenue")
    cust = F.concat(F.col("party"), F.lit(" at "), _pct0(F.col("latest")), F.lit(" of "), of, trend)
    supp = F.concat(F.col("party"), F.lit(" at "), _pct0(F.col("latest")), F.lit(" of purchases"), trend)
    is_c, v = F.col("kind") == "customer", F.col("latest")
    return _emit(top, [
        signal(is_c & (v >= watch), F.when(v >= alert, "medium").otherwise("info"), "Key-customer concentration", cust),
        signal(~is_c & (v >= supplier), "info", "Supplier concentration", supp)], FOOTNOTES, key)


def _against_cap(value: Column, watch: float | None, alert: float) -> tuple[Column, Column, Column]:
    cap = F.col("market_cap")
    share = F.when(cap != 0, ratio(value, cap))
    show = value > 0
    if watch is not None:
        show = show & F.coalesce(share >= watch, F.lit(True))
    return show, F.when(share >= alert, "medium").otherwise("info"), share


def _of_cap(share: Column, before: str, after: str, otherwise: str = "") -> Column:
    return F.when(share.isNotNull(), F.concat(F.lit(before), _pct0(share), F.lit(after))).otherwise(otherwise)


def fact_signals(facts: DataFrame, caps: DataFrame, year: Column, key: str = "ticker") -> DataFrame:
    """Rules over the figures of ``footnote_facts``; a figure that is missing gives no signal.

    Debt due within two years over all face value; peak utilisation of a facility; unrecognised
    compensation, underfunding and supplier finance against the market cap (info where it is unknown);
    share of level-3 measurements.
    """
    d = facts.join(caps.select(key, "market_cap"), key, "left")
    c = F.col
    wall = ratio("near", "face")
    peak = c("utilization")
    comp_on, comp_sev, comp = _against_cap(c("comp_cost"), COMP_WATCH, COMP_ALERT)
    pen_on, pen_sev, pen = _against_cap(c("underfunded"), None, PENSION_ALERT)
    fin_on, fin_sev, fin = _against_cap(c("outstanding"), SUPPLIER_FINANCE_WATCH, COMP_ALERT)
    return _emit(d, [
        signal((c("near") > 0) & (wall >= WALL_RATIO), "medium", "Debt maturity wall", F.concat(
            X.usd_text("near"), F.lit(" of "), X.usd_text("face"), F.lit(" face amount ("), _pct0(wall), F.lit(") matures by "), (year + WALL_YEARS).cast("string"))),
        signal(peak >= FACILITY_ALERT, "medium", "Credit facilities heavily drawn", F.concat(F.lit("peak utilization "), _pct0(peak), F.lit(HEAVILY_DRAWN))),
        signal((peak >= FACILITY_WATCH) & (peak < FACILITY_ALERT), "info", "High credit-line utilization", F.concat(F.lit("peak utilization "), _pct0(peak), F.lit(DRAWN))),
        signal(comp_on, comp_sev, "Unvested equity compensation", F.concat(X.usd_text("comp_cost"), F.lit(COMP_COST), _of_cap(comp, " (", " of market cap)"), F.lit(COMP_END))),
        signal(pen_on, pen_sev, "Underfunded pension plans", F.concat(X.usd_text("underfunded"), F.lit(UNDERFUNDED), _of_cap(pen, " (", " of market cap)"))),
        signal(fin_on, fin_sev, "Supplier-finance obligations", F.concat(X.usd_text("outstanding"), F.lit(SUPPLIER_PROGRAMS), _of_cap(fin, " — ", " of market cap"))),
        signal(c("level3") >= LEVEL3_WATCH, "info", "Opaque Level 3 valuations", F.concat(_pct0(c("level3")), F.lit(UNOBSERVABLE)))], FOOTNOTES, key)


def geography_leaves(buckets: DataFrame, key: str = "ticker") -> DataFrame:
    """Countries and residuals as they are, regions reduced to what their country leaves do not explain.

    ``buckets``: ticker, bucket (countries / regions / residuals / usStates), name, continent, value,
    other, explained.
    """
    pos = buckets.filter((F.col("value") > 0) & F.col("bucket").isin("countries", "regions", "residuals"))
    by_continent = (pos.filter(F.col("bucket") == "countries").filter("continent IS NOT NULL")
                    .groupBy(key, "continent").agg(F.sum("value").alias("_countries")))
    d = pos.join(by_continent, [key, "continent"], "left")
    explained = F.coalesce("explained", F.when(F.col("continent").isNotNull(), F.coalesce("_countries", F.lit(0.0))).otherwise(0.0))
    left = F.when(F.col("bucket") == "regions", F.coalesce("other", F.col("value") - explained)).otherwise(F.col("value"))
    return d.withColumn("value", left).filter(F.col("value") > 0).select(key, F.col("name").alias("party"), "value")


def geography_signals(leaves: DataFrame, revenue: DataFrame, key: str = "ticker", watch: float = COUNTRY_WATCH) -> DataFrame:
    """Speaks only when the leaves add up to the filer's own revenue."""
    d = (leaves.groupBy(key).agg(F.sum("value").alias("total"), F.max_by("party", F.when(F.col("party").isNotNull(), F.struct("value", "party"))).alias("party"), F.max(F.when(F.col("party").isNotNull(), F.col("value"))).alias("value"))
         .join(revenue.select(key, "revenue"), key, "left"))
    match = ratio("total", F.when(F.col("revenue") > 0, F.col("revenue"))).between(*RECONCILED)
    share = ratio("value", "total")
    return _emit(d, [signal(match & (share >= watch), "info", "Geographic revenue concentration",
                            F.concat(_pct0(share), F.lit(" of revenue from "), F.col("party")))], FOOTNOTES, key)


def product_signals(products: DataFrame, revenue: DataFrame, geography_total: DataFrame | None = None, key: str = "ticker", watch: float = PRODUCT_WATCH) -> DataFrame:
    """Largest product line of revenue; lines above revenue are dropped, the geography total stands in."""
    d = products.filter(F.col("value") > 0).join(revenue.select(key, "revenue"), key, "left")
    base = F.when(F.col("revenue") > 0, F.col("revenue"))
    if geography_total is not None:
        d = d.join(geography_total.select(key, F.col("total").alias("_geo")), key, "left")
        base = F.coalesce(base, F.col("_geo"))
    d = d.withColumn("base", base).filter((F.col("base") > 0) & (F.col("value") <= F.col("base")))
    top = d.groupBy(key).agg(F.max_by("product", F.struct("value", "product")).alias("party"), F.max("value").alias("value"), F.max("base").alias("base"))
    share = ratio("value", "base")
    return _emit(top, [signal(share >= watch, "info", "Product revenue concentration", F.concat(_pct0(share), F.lit(" of revenue from "), F.col("party")))], FOOTNOTES, key)


def segment_signals(segments: DataFrame, key: str = "ticker", watch: float = SEGMENT_WATCH) -> DataFrame:
    d = segments.filter(F.col("value") > 0).groupBy(key).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("segment", F.struct("value", "segment")).alias("party"), F.max("value").alias("value"))
    share = ratio("value", "total")
    return _emit(d, [signal((F.col("n") >= 2) & (share >= watch), "info", "Segment revenue concentration",
                            F.concat(_pct0(share), F.lit(" of revenue from the "), F.col("party"), F.lit(" segment")))], FOOTNOTES, key)


# ---- payload readers: (ticker, kind, payload VARIANT) -> the tables above ------------------------

# Payload kinds and member names.
WALKED = ["debt-structure", "credit-facilities", "stock-compensation", "retirement-plans", "supplier-finance", "fair-value-hierarchy"]
KINDS = ["concentration", *WALKED, "revenue-segmentation", "business-segmentation"]
INSTRUMENTS, FACE = ("instruments", "tranches", "data"), ("faceAmount", "face", "carryingAmount", "amount", "principal")
VALUE = ("value", "revenue", "amount")


def footnote_facts(footnotes: DataFrame, year: Column, key: str = "ticker") -> DataFrame:
    """One row of figures per ticker from the payload kinds whose objects may stand at any depth.

    Facilities are read in the whole payload, the others in its newest block. Debt is the newest block's
    list of instruments, or, where it has none, every object of the payload that names a due year. One walk
    serves all kinds, and one aggregation all figures.
    """
    v = F.col("payload")
    d = footnotes.filter(F.col("kind").isin(WALKED)).select(key, "kind", "payload", VA.latest_block(v).alias("block"))
    debt = F.col("kind") == "debt-structure"
    d = d.select(key, "kind", "payload", "block", F.when(debt, VA.objects(VA.fields(F.col("block")), *INSTRUMENTS)).alias("instruments"))
    root = F.when(F.col("kind") == "credit-facilities", v).when(debt, F.when(F.col("instruments").isNull() & F.col("block").isNotNull(), v)).otherwise(F.col("block"))
    d = stable(d.select(key, "kind", "instruments", root.alias("root")))
    nodes = VA.object_nodes(d, "root", [key, "kind"])
    nodes = nodes.unionByName(d.select(key, "kind", F.explode("instruments").alias("members")))
    n = nodes.select(key, "kind", F.map_filter(F.transform_values("members", lambda _, x: VA.number(x)), lambda _, x: x.isNotNull()).alias("n"))
    named = lambda *keys: F.coalesce(*[F.try_element_at("n", F.lit(k)) for k in keys])
    largest = lambda keep: F.array_max(F.map_values(F.map_filter("n", lambda k, x: keep(F.lower(k)) & (x > 0))))
    at = lambda kind, x: F.when(F.col("kind") == kind, x)
    positive = lambda x: F.when(x > 0, x)
    due, face = named("dueYear"), named(*FACE)
    face = at("debt-structure", F.when(due.isNotNull() & (face > 0), face))
    owed = lambda k: k.rlike("outstanding|obligation") & ~k.rlike("current|settled|added|paid")
    return n.groupBy(key).agg(
        F.sum(face).alias("face"), F.sum(F.when(due <= year + WALL_YEARS, face)).alias("near"),
        F.max(at("credit-facilities", positive(share_norm(named("utilization"))))).alias("utilization"),
        F.max(at("stock-compensation", largest(lambda k: k.contains("unrecognized")))).alias("comp_cost"),
        (-F.sum(at("retirement-plans", F.least(F.lit(0.0), named("fundedStatus"))))).alias("underfunded"),
        F.max(at("supplier-finance", largest(owed))).alias("outstanding"),
        F.max(at("fair-value-hierarchy", positive(share_norm(named("level3Share"))))).alias("level3"))


def concentration_table(footnotes: DataFrame, key: str = "ticker") -> DataFrame:
    """Shares of every counterparty's history with their places; a period that is missing or blank is null."""
    groups = VA.listed(F.col("payload"), "series", "categories", "groups", "data")
    d = footnotes.filter(F.col("kind") == "concentration").select(key, F.posexplode(groups).alias("g_at", "g"))
    risk = F.lower(F.coalesce(VA.first_text(F.col("g"), "riskType", "risk_type", "type", "category", "risk"), F.lit("")))
    parties = F.coalesce(VA.objects(F.col("g"), "counterparties", "parties", "items", "members", "series", "data"),
                         F.when(F.map_contains_key("g", "history") | F.map_contains_key("g", "share"), F.array("g")))
    d = d.select(key, risk.alias("risk"), "g_at", F.posexplode(parties).alias("p_at", "p"))
    points = F.coalesce(VA.objects(F.col("p"), "history", "points", "values", "data"), F.array("p"))
    name = F.coalesce(VA.first_text(F.col("p"), "name", "label", "counterparty", "party"), VA.first_text(F.col("p"), "member"), F.lit("a key counterparty"))
    entry = F.shiftleft(F.col("g_at").cast("long"), 32) + F.col("p_at")
    d = d.select(key, "risk", name.alias("party"), entry.alias("entry"), F.posexplode(points).alias("position", "h"))
    period = F.nullif(F.try_variant_get(VA.member(F.col("h"), "period"), "$", "string"), F.lit(""))
    return d.select(key, "risk", "party", "entry", "position", period.alias("period"),
                    share_norm(VA.first_number(F.col("h"), "share", "shareOfTotal", "value", "percent")).alias("share")).filter("share IS NOT NULL")


def _block(footnotes: DataFrame, kind: str, key: str) -> DataFrame:
    return footnotes.filter(F.col("kind") == kind).select(key, VA.fields(VA.latest_block(F.col("payload"))).alias("b"))


def geography_table(footnotes: DataFrame, key: str = "ticker") -> DataFrame:
    d = _block(footnotes, "revenue-segmentation", key).select(key, VA.fields(VA.member(F.col("b"), "geography")).alias("geo"))
    parts = F.array(*[F.struct(F.lit(b).alias("bucket"), VA.objects(F.col("geo"), b).alias("items")) for b in ("countries", "regions", "residuals")])
    d = d.select(key, F.explode(parts).alias("b")).select(key, "b.bucket", F.explode("b.items").alias("i"))
    i = F.col("i")
    return d.select(key, "bucket", VA.first_text(i, "name", "code", "member").alias("name"), VA.first_text(i, "continent").alias("continent"),
                    VA.first_number(i, *VALUE).alias("value"), VA.first_number(i, "other").alias("other"), VA.first_number(i, "explainedByCountries").alias("explained"))


def product_table(footnotes: DataFrame, key: str = "ticker") -> DataFrame:
    d = _block(footnotes, "revenue-segmentation", key).select(key, F.explode(VA.objects(F.col("b"), "product")).alias("i"))
    return d.select(key, VA.first_text(F.col("i"), "name", "member").alias("product"), VA.first_number(F.col("i"), *VALUE).alias("value")).filter("product IS NOT NULL")


def segment_table(footnotes: DataFrame, key: str = "ticker") -> DataFrame:
    d = _block(footnotes, "business-segmentation", key).select(key, F.explode(VA.objects(F.col("b"), "segments")).alias("i"))
    i = F.col("i")
    role = ~F.map_contains_key(i, "role") | F.coalesce(F.try_variant_get(VA.member(i, "role"), "$", "string") == "segment", F.lit(False))
    return d.filter(role).select(key, VA.first_text(i, "name", "member").alias("segment"), VA.first_number(VA.fields(VA.member(i, "metrics")), "revenue").alias("value")).filter("segment IS NOT NULL")


def segmentation_signals(footnotes: DataFrame, revenue: DataFrame, key: str = "ticker") -> DataFrame:
    """Geography, product and segment rules over the payloads and the filer's own revenue."""
    leaves = stable(geography_leaves(geography_table(footnotes, key), key))
    return (geography_signals(leaves, revenue, key)
            .unionByName(product_signals(product_table(footnotes, key), revenue, leaves.groupBy(key).agg(F.sum("value").alias("total")), key))
            .unionByName(segment_signals(segment_table(footnotes, key), key)))


def footnote_signals(footnotes: DataFrame, caps: DataFrame, revenue: DataFrame, year: Column, key: str = "ticker") -> DataFrame:
    """All payload rules over (ticker, kind, payload VARIANT); partition the lake by kind, and each rule reads its kinds only."""
    return (concentration_signals(concentration_table(footnotes, key), key)
            .unionByName(fact_signals(footnote_facts(footnotes, year, key), caps, year, key))
            .unionByName(segmentation_signals(footnotes, revenue, key)))
