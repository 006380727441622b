"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, running_total, stage


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row per source: rank, weight, size, the words of all sources before it, and target.

    Targets are the weights' shares of ``share`` times all words, where none exceeds ``repeats``
    times its source; what is cut off goes to the others by weight. That fixed point is found in one
    pass over the sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    everything = Window.partitionBy()
    sources = (
        sources.withColumn("source_start", F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("cap"))
    )
    order = F.row_number().over(filling)
    sources = sources.withColumn("_order", order)
    first = F.min(F.when(F.col("_fits"), F.struct("_order", "_level"))).over(everything)["_level"]
    target = F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("weight")))
    return sources.withColumn("target", target).select("source", "rank", "weight", "source_size", "source_start", "target")


def position(share_done: Column, slope: Column) -> Column:
    """When a source has met this share of its target, if its weight runs as 1 + slope * (2t - 1).

    The integral of that weight is (1 - slope) t + slope t^2; this is its inverse.
    """
    b = F.lit(1.0) - slope
    return F.when(slope == 0, share_done).otherwise((F.sqrt(b * b + F.lit(4.0) * slope * share_done) - b) / (F.lit(2.0) * slope))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    slopes: Sequence[float] = (0.5, 0.0, -0.5),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, takes.

    ``takes`` is an array of (epoch, words, position), one entry for each time that the mix uses the
    document; the one that crosses the target is cut there, so a source's taken words are its target
    rounded to a word. Within a source the order is that of md5(doc_id), so reruns agree.

    Null and empty texts have size 0 and are never taken. A null source is a source of its own, the
    last. A null doc_id is ordered as the text 'null'. Rows that repeat a doc_id are separate
    documents next to each other, in the order of a hash of their texts. A source without words has the
    target 0. A very long text counts like any other, and is cut where it crosses the target. An empty
    table gives an empty plan. Other columns are not read.
    """
    return _plan(docs, weights, share, repeats, slopes).drop("_t")


def _plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, slopes: Sequence[float] = (0.5, 0.0, -0.5)) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_t")), "sizes")
    sources = stage(source_targets(sized, weights, share, repeats), "sources")
    ranked = sized.join(sources.select("source", "rank").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    placed = running_total(ranked, ["rank", "_h", "doc_id", "_t"], "size", "_before").drop("_h")
    placed = placed.join(sources.drop("source"), "rank").withColumn("_before", F.col("_before") - F.col("source_start"))
    goal = F.floor(F.col("target") + 0.5)
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    takes = []
    for epoch in range(repeats):
        start = F.col("_before") + F.lit(epoch) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start)).cast("long")
        takes.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), position(F.try_divide(start.cast("double"), F.col("target")), slope).alias("position")))
    placed = placed.withColumn("takes", F.filter(F.array(*takes), lambda x: x["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes", "_t")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: every document once for each take, range-sorted by position.

    Columns are those of ``docs``, whatever their names. Documents aren't cut: the one that crosses its
    source's target comes whole, so a source exceeds its target by less than that document. Of rows
    that repeat a doc_id and source each has the takes of its own text; those with equal texts too share
    the number of their takes. Rows that aren't taken (null and empty texts among them) are left out.
    An empty table gives an empty result.
    """
    key = ["_d", "_s", "_t"]
    plan = _plan(docs, **options).filter("size(takes) > 0")
    plan = stage(plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "_t", F.transform("takes", lambda x: x["position"]).alias("_at")), "takes")
    # the row as one value, so that no name of its columns clashes
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.xxhash64("text").alias("_t"), row)
    repeated = stage(plan.groupBy(*key).count().filter("count > 1").drop("count"), "repeated")

    def met(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"{c}_") if c in on else F.col(c) for c in right.columns])
        return left.join(right, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in on], how).drop(*[f"{c}_" for c in on])

    if repeated.isEmpty():
        taken = met(rows, plan, key, "inner")
    else:  # rows of one key are numbered, as are the takes of its rows
        copies = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
        single = met(met(rows, repeated, key, "left_anti"), plan, key, "inner")
        several = met(copies(met(rows, repeated, key, "left_semi")), copies(met(plan, repeated, key, "left_semi")), [*key, "_n"], "inner")
        taken = single.select("row", "_at").unionByName(several.select("row", "_at"))
    taken = taken.select("row", F.explode("_at").alias("at"))
    return taken.repartitionByRange("at", "row.doc_id").sortWithinPartitions("at", "row.doc_id").select("row.*")
