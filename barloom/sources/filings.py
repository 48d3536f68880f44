"""Company-facts payloads to point-in-time quarterly filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Accounting concepts per field, in order of preference.
CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "eps": ["EarningsPerShareDiluted"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"],
    "shares": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
    "gross_profit": ["GrossProfit"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "assets": ["Assets"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "rnd": ["ResearchAndDevelopmentExpense"],
    "debt": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
}
# Accepted form types and units (a unit earlier in the list wins).
FORMS = ["10-Q", "10-K", "10-Q/A", "10-K/A"]
UNITS = ["USD/shares", "shares", "USD"]
PAYLOAD = "map<string, struct<units: map<string, array<struct<start: date, end: date, val: double, form: string, filed: date>>>>>"
OPTIONAL = ["gross_profit", "cost_of_revenue", "assets", "equity", "net_income", "rnd", "debt", "cash"]


def explode_facts(payload: DataFrame, body: str = "body", cik: str = "cik") -> DataFrame:
    """``(cik, concept, unit, start, end, val, form, filed)`` from one JSON document per filer."""
    c = payload.select(cik, F.explode(F.from_json(body, PAYLOAD)).alias("concept", "_c"))
    u = c.select(cik, "concept", F.explode("_c.units").alias("unit", "_f"))
    return u.select(F.col(cik).alias("cik"), "concept", "unit", F.inline("_f"))


def concept_preference(spark) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("concept"), F.lit(i).alias("pref")) for f, cs in CONCEPTS.items() for i, c in enumerate(cs)])
    return spark.range(1).select(F.inline(rows))


def coalesce_concepts(facts: DataFrame) -> DataFrame:
    """Facts of the first concept each filer uses per field, in its preferred unit."""
    pref = F.array_position(F.array(*[F.lit(u) for u in UNITS]), F.col("unit"))
    x = facts.where(F.col("unit").isin(UNITS)).join(F.broadcast(concept_preference(facts.sparkSession)), "concept").withColumn("_u", pref)
    pick = x.groupBy("cik", "field").agg(F.min(F.struct("pref", "_u")).alias("_b"))
    return x.join(pick, ["cik", "field"]).where((F.col("pref") == F.col("_b.pref")) & (F.col("_u") == F.col("_b._u"))).drop("_b", "_u", "pref")


def original_values(facts: DataFrame, keep_amendments: bool = False) -> DataFrame:
    """Accepted forms only; the earliest filing per period end unless amendments are kept."""
    x = facts.where(F.coalesce("form", F.lit("10-Q")).isin(FORMS))
    if keep_amendments:
        return x
    w = Window.partitionBy("cik", "field", "end").orderBy("filed", "start", "val")
    return x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def quarter_values(facts: DataFrame) -> DataFrame:
    """Quarter-long or instant facts where a field has at least four, else year-to-date values differenced inside the fiscal year."""
    days = F.datediff("end", "start")
    q = days.isNull() | days.between(75, 100)
    whole = Window.partitionBy("cik", "field")
    x = facts.withColumns({"_q": q, "_nq": F.count_if(q).over(whole)})
    fy = Window.partitionBy("cik", "field", F.year("start")).orderBy("end")
    x = x.withColumn("val", F.when((F.col("_nq") >= 4) | F.col("start").isNull(), F.col("val")).otherwise(F.coalesce(F.col("val") - F.lag("val").over(fy), F.col("val"))))
    x = x.where((F.col("_nq") < 4) | F.col("_q"))
    w = Window.partitionBy("cik", "field", "end").orderBy("filed", "start")
    return x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("cik", "field", "end", "val", "filed")


def quarter_rows(values: DataFrame, lag_days: int = 90) -> DataFrame:
    """One row per filer and revenue period; missing fields stay NULL and a missing publication date becomes period end + 90 days."""
    at = lambda f, c="val": F.max(F.when(F.col("field") == f, F.col(c)))
    g = values.groupBy("cik", F.col("end").alias("period_end")).agg(at("revenue", "filed").alias("published"), *[at(f).alias(f) for f in CONCEPTS], F.max(F.col("field") == "revenue").alias("_has"))
    g = g.where("_has").withColumn("published", F.coalesce("published", F.date_add("period_end", lag_days)))
    return g.select("cik", "period_end", "published", "revenue", "eps", (F.col("ocf") - F.coalesce("capex", F.lit(0.0))).alias("fcf"), "shares", *OPTIONAL)
