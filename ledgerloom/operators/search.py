"""Search in documents and evidence figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(text) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def full_text(docs: DataFrame, query: str) -> DataFrame:
    """Documents that hold all words of a query; if there is none, those that hold any as a part."""
    words = [w for w in query.lower().split() if w]
    every = F.lit(True)
    some = F.lit(False)
    tokens = words_of(F.col("text"))
    for w in words:
        every = every & F.array_contains(tokens, w)
        some = some | F.lower("text").contains(w)
    marked = docs.select("doc_id", every.alias("every"), some.alias("some")).filter("every or some")
    any_full = marked.agg(F.coalesce(F.max("every"), F.lit(False)).alias("full"))
    return marked.crossJoin(F.broadcast(any_full)).filter("every or not full").select("doc_id", "every")  # one row


def contains_all(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose column holds all words, whatever their case."""
    for w in words:
        rows = rows.filter(F.col(column).ilike(f"%{w}%"))
    return rows


def compared_periods(figures: DataFrame) -> DataFrame:
    """The latest two periods of each label of an entity and their change."""
    w = Window.partitionBy("entity_id", "label").orderBy(F.col("period").desc())
    rows = figures.withColumn("rank", F.row_number().over(w)).withColumn("previous", F.lead("amount").over(w))
    return rows.filter("rank = 1 and previous is not null").select("entity_id", "label", "period", "amount", "previous", (F.col("amount") - F.col("previous")).alias("change"))


def flagged_rows(lines: DataFrame, flags: Column, per_flag: int) -> DataFrame:
    """For each flag of a line (an array of keys) the largest lines, ties by date and id."""
    rows = lines.withColumn("flag", F.explode(flags))
    w = Window.partitionBy("flag").orderBy(F.abs("amount").desc(), "day", "line_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_flag).select("flag", "rank", "line_id", "day", "amount")


def voted_types(votes: DataFrame, least: int = 3, percent: int = 80) -> DataFrame:
    """A leading digit's majority type if it has enough votes and a clear majority."""
    counts = votes.groupBy("digit", "type").agg(F.count("*").alias("n"))
    sums = counts.groupBy("digit").agg(F.sum("n").alias("total"), F.max_by("type", F.struct("n", "type")).alias("type"), F.max("n").alias("n"))
    return sums.filter((F.col("total") >= least) & (F.col("n") * 100 >= F.col("total") * percent)).select("digit", "type", "n", "total")
