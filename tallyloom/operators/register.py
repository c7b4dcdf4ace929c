"""Shareholder registers: class totals, buckets of non-resident holders, investors and countries.

Every job sums by filing, so Spark adds up within each task before it deals anything out; a filing
with very many holders costs no task more than its sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Countries that are home.
HOME = ("india", "indian", "in")
#: Words of a holder's type, category or name and the bucket they stand for, in the order of the tests.
BUCKETS = [
    ("nri_pio", ["nri", "pio", "non resident indian"]), ("individuals", ["individual", "person"]), ("fii", ["fii", "foreign institutional investor"]),
    ("fvci", ["fvci", "venture capital"]), ("trusts", ["trust"]), ("pe_funds", ["private equity", "pe fund"]), ("pension_funds", ["pension", "provident"]),
    ("swf", ["sovereign", "swf", "wealth fund"]), ("partnerships", ["partnership", "proprietorship", "firm"]), ("fin_institutions", ["financial institution"]),
]
ALL_BUCKETS = [*[b for b, _ in BUCKETS], "companies", "non_part_pref"]


def _clean(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _non_participating() -> Column:
    return (_clean("sec_type").contains("preference") | _clean("sec_class").contains("preference")) & (
        _clean("sec_class").rlike("non[- ]participating") | _clean("sec_type").contains("non-participating")
    )


def scoped(holders: DataFrame) -> DataFrame:
    """Equity and preference holdings; debentures and the like go. Null numbers count as 0."""
    kept = holders.filter(_clean("sec_type").rlike("equity|preference"))
    return kept.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("securities", "amount")})


def foreign(holders: DataFrame) -> DataFrame:
    return scoped(holders).filter(~_clean("country").isin(*HOME))


def class_totals(holders: DataFrame) -> DataFrame:
    """For each filing and share class (equity, part_pref, non_part_pref): count, amount, number of class names and the first positive face value by row_no (ties: the smaller)."""
    kind = F.when(_non_participating(), "non_part_pref").when(_clean("sec_type").contains("preference"), "part_pref").otherwise("equity")
    first = F.min(F.when(F.col("face_value") > 0, F.struct("row_no", "face_value"))).getField("face_value")
    return scoped(holders).groupBy("filing_id", kind.alias("share_class")).agg(F.sum("securities").alias("count"), F.sum("amount").alias("amount"), F.countDistinct("sec_class").alias("n_classes"), first.alias("face_value"))


def bucket() -> Column:
    """The bucket of a foreign holding; what no word tells is a company's."""
    text = F.concat_ws(" ", _clean("holder_type"), _clean("category"), _clean("name"))
    out = F.when(_non_participating(), "non_part_pref")
    for name, words in BUCKETS:
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w)
        if name == "fin_institutions":
            test = test | text.rlike(r"(^|\s)fi(\s|$)")
        out = out.when(test, name)
    return out.otherwise("companies")


def nonresident_buckets(holders: DataFrame) -> DataFrame:
    """filing_id and, for each of the 12 buckets, count and amount of foreign holdings; 0 where there are none."""
    rows = foreign(holders).withColumn("bucket", bucket())
    wide = rows.groupBy("filing_id").pivot("bucket", ALL_BUCKETS).agg(F.sum("securities").alias("count"), F.sum("amount").alias("amount"))
    return wide.na.fill(0.0)


def investors(holders: DataFrame) -> DataFrame:
    """Foreign holders of a filing by clean name and country: securities, percent of all of the filing's, and direct (10 percent or more)."""
    each = scoped(holders).groupBy("filing_id", _clean("name").alias("name"), _clean("country").alias("country")).agg(F.sum("securities").alias("securities"))
    each = each.withColumn("total", F.sum("securities").over(Window.partitionBy("filing_id"))).filter(~F.col("country").isin(*HOME))
    percent = F.try_divide(F.col("securities"), F.col("total")) * 100
    return each.withColumn("percent", F.coalesce(percent, F.lit(0.0))).withColumn("direct", F.col("percent") >= 10).drop("total")


def other_countries(investors_: DataFrame) -> DataFrame:
    """Holdings that are not a direct investor's, by country: securities, percent and number of holders."""
    return investors_.filter("not direct").groupBy("filing_id", "country").agg(F.sum("securities").alias("securities"), F.sum("percent").alias("percent"), F.count("*").alias("n_holders"))


def ranked(investors_: DataFrame) -> DataFrame:
    """Investors with their rank by holding, the largest first and ties by name and country."""
    by = Window.partitionBy("filing_id").orderBy(F.desc("securities"), "name", "country")
    return investors_.withColumn("rank", F.row_number().over(by))
