"""Mixing sources to target weights.

The tokens of each source are summed, a repetition rate follows for each source, and every document
goes out floor(rate) times plus one copy that a hash-seeded Bernoulli draw grants with the
probability of the fraction. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
LIMIT = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size and target from rows of source and size.

    Sources stand by code point, null last, and the weights repeat along them. Targets share the
    sum of all sizes by weight; none exceeds limit x its source's size, and what is above goes to
    the others by weight. So each target is min(limit x size, level x weight) for one level. It is
    found by adding up the limits in order of limit / weight. The windows here run over one row a
    source, summed before.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumns({"weight": weight, "cap": limit * F.col("source_size")})
        .withColumns({
            "left": F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "heavy": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        })
    )
    # the first source, in that order, that what is left does not fill sets the level
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("heavy")
    level = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("heavy")))).over(all_)
    share = F.col("weight") * F.col("level.left") / F.col("level.heavy")
    target = F.least(F.col("cap").cast("double"), F.coalesce(share, F.col("cap").cast("double")))
    return parts.withColumn("level", level).select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number from 0 up to 1 that the seed and the key fix."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of documents.

    size counts the words of the text (null: 0). A source without words has target 0 and its
    documents go out 0 times. Rows of equal doc_id share their draw; a null doc_id draws as the
    empty text. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    sizes = Scratch(spark, "mix").save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, limit).withColumnRenamed("source", "of")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = draw(F.col("doc_id"), seed) < rate - F.floor(rate)
    return (
        sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.floor(rate) + extra.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as the mix takes it; repeats are equal rows.

    Only the rate of each source joins the texts, on the source, so that texts are not dealt out
    by a key unless the table of sources is itself large; then Spark splits the hot ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix-emit")
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = scratch.save(source_targets(sizes, weights, limit), "targets").select(F.col("source").alias("__of"), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("__rate"))
    rate = F.col("__rate")
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return (
        docs.join(targets, F.col("source").eqNullSafe(F.col("__of")))
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*docs.columns)
    )
