"""This year's fields against the previous return's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import clean_key
from tallyloom.operators.lookup import contained
from tallyloom.sources.shared import saved


def resolve(rule: Column, prev: Column, curr: Column) -> tuple[Column, Column]:
    """Final value and reason. A rule with UNLESS keeps the previous value unless the current one differs; else the current one counts if there is one.

    Null counts as empty.
    """
    prev, curr = F.coalesce(prev, F.lit("")), F.coalesce(curr, F.lit(""))
    unless, p, c = rule.contains("UNLESS"), prev != "", curr != ""
    value = F.when(unless, F.when(p & ~c, prev).when(p & c & (prev == curr), prev).otherwise(curr)).otherwise(F.when(c, curr).otherwise(prev))
    reason = F.when(
        unless,
        F.when(p & ~c, "Current Value Missing -> Used Previous").when(p & c & (prev == curr), "Current Value Same -> Used Previous")
        .when(p & c, "Current Value Different -> Used Current").when(c, "Previous Missing -> Used Current").otherwise("Both Missing -> Left Blank"),
    ).otherwise(F.when(c, "Current Value Present -> Used Current").otherwise("Current Value Missing -> Used Previous"))
    return value, reason


def strict_validation(pairs: DataFrame) -> DataFrame:
    """Adds final and reason to rows of prev and curr; rows with neither are left out."""
    prev, curr = F.coalesce("prev", F.lit("")), F.coalesce("curr", F.lit(""))
    reason = F.when((prev != "") & (curr == ""), "Missing in Current -> Needs Review").when(prev == curr, "Values Match Perfectly").otherwise("Mismatch Detected -> Needs Review")
    return pairs.filter((prev != "") | (curr != "")).withColumn("final", curr).withColumn("reason", reason)


def severity(reason: Column) -> Column:
    return F.when(reason.contains("Mismatch"), "mismatch").when(reason.contains("Missing"), "missing").otherwise("ok")


def year_on_year(facts: DataFrame) -> DataFrame:
    """This filing's previous-year column against last year's filing: company, fiscal_year, item, stated, filed and agrees.

    Tolerance is 1 or one percent of what was filed, whichever is more. Items that last year's
    filing lacks have filed null and agrees null.
    """
    filed = facts.select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), "item", F.col("fy").alias("filed"))
    stated = facts.select("company", "fiscal_year", "item", F.col("py").alias("stated"))
    agrees = F.abs(F.col("stated") - F.col("filed")) <= F.greatest(F.lit(1.0), 0.01 * F.abs("filed"))
    return stated.join(filed, ["company", "fiscal_year", "item"], "left").withColumn("agrees", agrees)


def match_pairs(keys: DataFrame, fields: DataFrame) -> DataFrame:
    """key, field and tier of all pairs that match: 1 equal, 2 equal but for case, 3 equal letters and digits, 4 one within the other (over 3 letters).

    keys and fields have one column of that name. All tiers are joins on a key: what lies within
    another is looked up by its rarest gram.
    """
    alnum = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    k = saved(keys.select("key", alnum(F.col("key")).alias("a")), "keys")
    f = fields.select("field", alnum(F.col("field")).alias("b"))
    tier = lambda df, n: df.select("key", "field", F.lit(n).alias("tier"))
    texts = lambda df, c: df.filter(F.length(c) > 3).select(F.col(c).alias("text"))
    pairs = contained(texts(k, "a"), texts(f, "b"), 4).toDF("a", "b").union(contained(texts(f, "b"), texts(k, "a"), 4).toDF("b", "a").select("a", "b")).distinct()
    found = [
        tier(k.join(f, F.col("key") == F.col("field")), 1), tier(k.join(f, F.lower("key") == F.lower("field")), 2), tier(k.join(f, F.col("a") == F.col("b")), 3), tier(k.join(pairs, "a").join(f, "b"), 4),
    ]
    return reduce(DataFrame.union, found).groupBy("key", "field").agg(F.min("tier").alias("tier"))


def cascade_match(keys: DataFrame, fields: DataFrame) -> DataFrame:
    """key, field and tier for each key by the tiers of match_pairs, within a tier the first field in order (ord); no match: field Unknown, tier 5."""
    pairs = match_pairs(keys, fields.select("field")).join(fields.select("field", "ord"), "field")
    best = pairs.groupBy("key").agg(F.min(F.struct("tier", "ord", "field")).alias("b")).select("key", "b.field", "b.tier")
    return keys.join(best, "key", "left").select("key", F.coalesce("field", F.lit("Unknown")).alias("field"), F.coalesce("tier", F.lit(5)).alias("tier"))


def canonical_values(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """filing_id, field and value under canonical names: an existing canonical key stays, else the first variant present counts."""
    v = values.withColumn("k", clean_key(F.col("key")))
    named = v.join(aliases.withColumn("k", clean_key(F.col("variant"))), "k")
    own = v.join(aliases.select(F.col("canonical"), clean_key(F.col("canonical")).alias("k")).distinct(), "k").withColumn("variant_no", F.lit(-1))
    all_ = named.select("filing_id", "canonical", "value", "variant_no").union(own.select("filing_id", "canonical", "value", "variant_no"))
    return all_.groupBy("filing_id", F.col("canonical").alias("field")).agg(F.min_by("value", "variant_no").alias("value"))
