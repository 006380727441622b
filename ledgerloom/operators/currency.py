"""Foreign currency: rates in force, translation and revaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_index
from ..functions.money import div_round
from .ledger import date, total, trial_balance


def rates_as_of(days: DataFrame, rates: DataFrame) -> DataFrame:
    """For each day the latest spot rate up to it, the latest of its month, and the first
    average dated at or behind it in its year; null where there is none.

    Days and rates are one stream in order of date, whose last known rate is carried on. It has a row for
    each calendar day at most, so one task can hold it."""
    of_kind = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rate")))
    known = rates.groupBy(F.col("rate_date").alias("day")).agg(of_kind("SPOT").alias("_spot"), of_kind("AVERAGE").alias("_mean")).withColumn("_asked", F.lit(False))
    stream = days.select("day", F.lit(None).cast("long").alias("_spot"), F.lit(None).cast("long").alias("_mean"), F.lit(True).alias("_asked")).unionByName(known)
    up_to, in_month = Window.partitionBy(F.lit(0)).orderBy("day"), Window.partitionBy(month_index("day")).orderBy("day")
    from_end = Window.partitionBy(F.year("day")).orderBy(F.desc("day"))
    stream = stream.select(
        "day",
        "_asked",
        F.last("_spot", ignorenulls=True).over(up_to).alias("spot"),
        F.last("_spot", ignorenulls=True).over(in_month).alias("closing"),
        F.last("_mean", ignorenulls=True).over(from_end).alias("average"),
    )
    return stream.filter("_asked").drop("_asked")


def entity_rates(lines: DataFrame, chart: DataFrame, entity: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Each foreign entity's closing rate, the average of the year and the historical rate, which is
    the closing rate of the month of its first entry; ``missing`` names those that there are not. An
    entity without income or expense in the year needs no average."""
    foreign = entity.filter("currency <> 'IDR'").select("entity_id")
    this_year = F.col("type").isin("INCOME", "EXPENSE") & (F.year("day") == F.year(date(as_of))) & (F.col("day") <= date(as_of))
    heads = lines.join(foreign, "entity_id").join(F.broadcast(chart.select("account", "type")), "account")  # a fixed list
    heads = heads.groupBy("entity_id").agg(F.last_day(F.min("day")).alias("day"), F.max(this_year).alias("_busy"))
    first = rates_as_of(heads.select("day").distinct(), rates).select("day", F.col("closing").alias("historical"))
    now = rates_as_of(lines.sparkSession.range(1).select(date(as_of).alias("day")), rates).select("closing", "average")
    heads = heads.join(first, "day").crossJoin(F.broadcast(now))  # one row of rates
    heads = heads.withColumn("average", F.coalesce("average", F.when(~F.col("_busy"), F.col("closing"))))
    gone = [F.when(F.col(k).isNull() & (F.col("_busy") if k == "average" else F.lit(True)), k.upper()) for k in ("closing", "average", "historical")]
    return heads.select("entity_id", "closing", "average", "historical", F.array_join(F.array(*gone), ",").alias("missing"))


def translated_trial_balance(lines: DataFrame, chart: DataFrame, entity: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """A10: a foreign entity's trial balance: assets and liabilities at the closing rate, income and
    expense at the average, equity at the historical one; what that leaves goes to the translation
    account. An entity whose rates are missing is left out; ``entity_rates`` names them. Rates are per
    unit, amounts cents, so results are cents."""
    at = entity_rates(lines, chart, entity, rates, as_of).filter("missing = ''")
    tb = trial_balance(lines.join(at.select("entity_id"), "entity_id", "left_semi"), chart, as_of, ("client_id", "entity_id")).join(at, "entity_id")
    rate = F.when(F.col("type").isin("ASSET", "LIABILITY"), F.col("closing")).when(F.col("type") == "EQUITY", F.col("historical")).otherwise(F.col("average"))
    rows = tb.select("client_id", "entity_id", "account", (F.col("net") * F.coalesce(rate, F.lit(0))).cast("long").alias("net"))
    residue = rows.groupBy("client_id", "entity_id").agg((-total("net")).alias("net")).withColumn("account", F.lit("3900"))
    return rows.unionByName(residue).groupBy("client_id", "entity_id", "account").agg(total("net").alias("net"))


def revaluation(lines: DataFrame, chart: DataFrame, entity: DataFrame, rates: DataFrame, as_of: str) -> DataFrame:
    """Monetary accounts of foreign entities: balance at the closing rate less what is carried at
    each entry's spot rate. ``missing`` counts the days without a spot rate and the closing rate if there
    is none; what a missing rate would decide is null."""
    foreign = entity.filter("currency <> 'IDR'").select("entity_id")
    money = F.broadcast(chart.filter("kind = 'MONETARY'").select("account"))  # a fixed list
    rows = lines.filter(F.col("day") <= date(as_of)).join(foreign, "entity_id").join(money, "account")
    daily = rows.groupBy("entity_id", "account", "day").agg(total(F.col("debit") - F.col("credit")).alias("balance"))
    spots = rates_as_of(daily.select("day").distinct(), rates).select("day", F.col("spot").alias("_spot"))
    closing = rates_as_of(lines.sparkSession.range(1).select(date(as_of).alias("day")), rates).select(F.col("closing").alias("_closing"))
    carried = daily.join(spots, "day").groupBy("entity_id", "account").agg(
        total("balance").alias("balance"), total(F.col("balance") * F.col("_spot")).alias("_carried"), F.count_if(F.col("_spot").isNull()).alias("_days")
    )
    carried = carried.crossJoin(F.broadcast(closing)).withColumn("carried", F.when(F.col("_days") == 0, F.col("_carried")))
    missing = F.col("_days") + F.when(F.col("_closing").isNull(), 1).otherwise(0)
    return carried.select("entity_id", "account", "balance", "carried", (F.col("balance") * F.col("_closing") - F.col("carried")).alias("difference"), missing.alias("missing"))


def inverse_rates(rates: DataFrame) -> DataFrame:
    """M7: the inverse of each rate with ten decimals."""
    return rates.filter("kind = 'SPOT'").select("rate_date", div_round(F.lit(10_000_000_000), "rate").alias("inverse"))
