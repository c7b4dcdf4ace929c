"""Queries of registers, the return grid and its comparison with the previous year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import comparison, register, return_grid
from tallyloom.plans.documents import ITEMS_SQL
from tallyloom.plans.registry import query, table
from tallyloom.sources.statements import line_items


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shareholder registers: a filing has the orders of 32 keys that follow each other, a holder is a supplier, a holding a line item. Every sixth filing has no register."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    who = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("Individual", "Body Corporate", "Trust", "Pension Fund", "Partnership Firm")]), F.col("n_regionkey") + 1)
    flag = F.col("l_returnflag")
    filing = F.floor(F.col("l_orderkey") / 32)
    return lines.filter(filing % 6 != 5).join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(
        filing.alias("filing_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"),
        F.col("s_name").alias("name"),
        F.when(F.col("n_name") == "NATION_0", "India").otherwise(F.col("n_name")).alias("country"),
        F.col("l_quantity").alias("securities"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("amount"),
        F.when(flag == "A", "Equity Shares").when(flag == "N", "Preference Shares").otherwise("Debentures").alias("sec_type"),
        F.when(F.col("l_linestatus") == "F", "Non-Participating").otherwise("Class O").alias("sec_class"),
        F.when(F.col("l_suppkey") % 3 == 0, 0.0).otherwise(F.col("l_suppkey") % 3 * 5.0).alias("face_value"),
        F.lit("").alias("holder_type"),
        kinds.alias("category"),
    )


HOLDERS_SQL = """
h0 AS (
  SELECT l_orderkey // 32 AS filing_id, l_orderkey * 10 + l_linenumber AS row_no, lower(s_name) AS name, CASE WHEN n_name = 'NATION_0' THEN 'india' ELSE lower(n_name) END AS country,
    l_quantity AS securities, l_extendedprice::DECIMAL(18,2) AS amount, l_linestatus, n_regionkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 * 5.0 END AS face_value,
    CASE WHEN l_returnflag = 'A' THEN 'equity' WHEN l_linestatus = 'F' THEN 'non_part_pref' ELSE 'part_pref' END AS share_class
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag <> 'R' AND l_orderkey // 32 % 6 <> 5)
"""


@query(
    "a1_class_totals",
    f"""WITH {HOLDERS_SQL} SELECT filing_id, share_class, sum(securities) AS "count", round(sum(amount)::DOUBLE, 2) AS amount, count(DISTINCT l_linestatus) AS n_classes,
      (min((row_no, face_value)) FILTER (WHERE face_value IS NOT NULL))[2]::DOUBLE AS face_value FROM h0 GROUP BY 1, 2""",
)
def a1_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.class_totals(holders(spark, sf_dir)).withColumn("amount", F.round("amount", 2))


@query(
    "a2_nonresident_buckets",
    f"""WITH {HOLDERS_SQL}, b AS (SELECT filing_id, securities, amount, CASE WHEN share_class = 'non_part_pref' THEN 'non_part_pref'
        ELSE ['individuals', 'companies', 'trusts', 'pension_funds', 'partnerships'][n_regionkey + 1] END AS bucket FROM h0 WHERE country <> 'india')
    SELECT filing_id, {", ".join(f"coalesce(sum(securities) FILTER (WHERE bucket = '{b}'), 0)::DOUBLE AS {b}_count, round(coalesce(sum(amount) FILTER (WHERE bucket = '{b}'), 0)::DOUBLE, 2) AS {b}_amount" for b in register.ALL_BUCKETS)}
    FROM b GROUP BY 1""",
)
def a2_nonresident_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = register.nonresident_buckets(holders(spark, sf_dir))
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.endswith("_amount")})


@query(
    "a5_investors",
    f"""WITH {HOLDERS_SQL}, t AS (SELECT filing_id, sum(securities) AS total FROM h0 GROUP BY 1),
    i AS (SELECT filing_id, name, country, sum(securities) AS securities FROM h0 WHERE country <> 'india' GROUP BY ALL)
    SELECT filing_id, name, country, securities, round(securities / total * 100, 6) AS percent, securities / total * 100 >= 10 AS direct,
      (row_number() OVER (PARTITION BY filing_id ORDER BY securities DESC, name, country))::INTEGER AS rank FROM i JOIN t USING (filing_id)""",
)
def a5_investors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.ranked(register.investors(holders(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query(
    "a6_other_countries",
    f"""WITH {HOLDERS_SQL}, t AS (SELECT filing_id, sum(securities) AS total FROM h0 GROUP BY 1),
    i AS (SELECT filing_id, name, country, sum(securities) AS securities FROM h0 WHERE country <> 'india' GROUP BY ALL),
    p AS (SELECT *, securities / total * 100 AS percent FROM i JOIN t USING (filing_id))
    SELECT filing_id, country, sum(securities) AS securities, round(sum(percent), 6) AS percent, count(*) AS n_holders FROM p WHERE percent < 10 GROUP BY 1, 2""",
)
def a6_other_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.other_countries(register.investors(holders(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each filing of the register; the previous year's shares are four fifths of this year's."""
    totals = register.class_totals(holders(spark, sf_dir))
    wide = totals.groupBy("filing_id").pivot("share_class", ["equity", "part_pref", "non_part_pref"]).agg(F.first("count").alias("count"), F.first("amount").alias("amount"))
    buckets = register.nonresident_buckets(holders(spark, sf_dir)).drop("non_part_pref_count", "non_part_pref_amount")
    rows = [b for b in register.ALL_BUCKETS if b != "non_part_pref"]
    g = wide.na.fill(0.0).join(buckets, "filing_id", "left").na.fill(0.0)
    lakh = return_grid.LAKH
    cells = {"i_c26": F.lit(10.0), "iii_d6": F.lit(2.0), "net_worth_fy": F.col("filing_id") % 2 * 1000.0, "net_worth_py": F.lit(0.0)}
    for r, b in zip((7, 8, 9), ("equity", "part_pref", "non_part_pref"), strict=True):
        cells |= {f"ii_d{r}": F.col(f"{b}_count") * 0.8, f"ii_e{r}": F.col(f"{b}_count"), f"ii_f{r}": F.col(f"{b}_amount") * 0.8 / lakh, f"ii_g{r}": F.col(f"{b}_amount") / lakh}
    for r, b in zip(return_grid.HOLDER_ROWS, rows, strict=True):
        cells |= {f"ii_d{r}": F.col(f"{b}_count") * 0.8, f"ii_e{r}": F.col(f"{b}_count")}
    cells |= {"ii_f27": F.col("equity_amount") / lakh, "ii_f28": F.lit(5.0), "ii_f29": F.lit(1.0), "ii_f32": F.col("filing_id") * 1.0, "ii_f39": F.lit(3.0), "ii_f40": F.lit(4.0)}
    cells |= {"iv_d26": F.lit(7.0), "iv_d28": F.col("filing_id") * 2.0, "iv_d27": F.lit(50.0), "iv_d31": F.lit(80.0)}
    return return_grid.formulas(g.select("filing_id", *[c.cast("double").alias(n) for n, c in cells.items()]))


@query(
    "g9_return_grid",
    f"""WITH {HOLDERS_SQL},
    c AS (SELECT filing_id, coalesce(sum(securities) FILTER (WHERE share_class = 'equity'), 0) AS e, coalesce(sum(securities) FILTER (WHERE share_class = 'part_pref'), 0) AS p,
      coalesce(sum(amount) FILTER (WHERE share_class = 'equity'), 0)::DOUBLE / 100000 AS ea, coalesce(sum(amount) FILTER (WHERE share_class = 'part_pref'), 0)::DOUBLE / 100000 AS pa,
      coalesce(sum(amount) FILTER (WHERE share_class = 'non_part_pref'), 0)::DOUBLE / 100000 AS na,
      coalesce(sum(securities) FILTER (WHERE share_class <> 'non_part_pref' AND country <> 'india'), 0) AS nr FROM h0 GROUP BY 1)
    SELECT filing_id, round(ea + pa, 4) AS ii_g6, round(ea + pa + na, 4) AS ii_g5, round(nr / (e + p) * (ea + pa), 4) AS ii_g11, round(nr / (e + p) * 100, 4) AS ii_g24,
      round(ea - 6, 4) AS ii_f30, round(0.8 * (ea + pa) + filing_id, 4) AS ii_f34, round(CASE WHEN filing_id % 2 = 1 THEN 1000 ELSE ea + pa END, 4) AS ii_g34, 7.0::DOUBLE AS ii_f41,
      (7.0 + filing_id * 2)::DOUBLE AS iv_d30, 0.04::DOUBLE AS iv_d39 FROM c""",
)
def g9_return_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ("ii_g6", "ii_g5", "ii_g11", "ii_g24", "ii_f30", "ii_f34", "ii_g34", "ii_f41", "iv_d30", "iv_d39")
    return grid(spark, sf_dir).select("filing_id", *[F.round(c, 4).alias(c) for c in cells])


@query(
    "v_grid_checks",
    f"""WITH {HOLDERS_SQL},
    c AS (SELECT filing_id, coalesce(sum(securities) FILTER (WHERE share_class = 'equity'), 0) AS e, coalesce(sum(amount) FILTER (WHERE share_class = 'equity'), 0)::DOUBLE AS ea FROM h0 GROUP BY 1)
    SELECT filing_id, unnest(['equity_capital', 'paid_up_capital', 'nonresident_percent', 'retained_profit', 'net_worth', 'purchases', 'direct_investors', 'overseas_net_worth']) AS "check",
      unnest([abs(ea * 0.8 / 100000 - e * 0.8 * 10 / 100000) < 0.01, true, true, true, true, true, true, true]) AS passed FROM c""",
)
def v_grid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return return_grid.checks(grid(spark, sf_dir))


@query(
    "j25_year_on_year",
    f"""WITH {ITEMS_SQL}, s AS (SELECT company, y, item, fy, CASE WHEN y % 3 = 0 THEN py * 1.02 ELSE py END AS stated FROM items)
    SELECT s.company, s.y AS fiscal_year, s.item, s.stated, b.fy AS filed, abs(s.stated - b.fy) <= greatest(1.0, 0.01 * abs(b.fy)) AS agrees
    FROM s LEFT JOIN s b ON s.company = b.company AND s.y = b.y + 1 AND s.item = b.item""",
)
def j25_year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = line_items(spark, sf_dir).withColumn("py", F.when(F.col("fiscal_year") % 3 == 0, F.col("py") * 1.02).otherwise(F.col("py")))
    return comparison.year_on_year(facts)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of two returns by customer, order status and year: the number of orders, empty where odd years had one only."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("field")).agg(F.count("*").alias("n"))
    now = orders.withColumn("value", F.when((F.col("n") == 1) & (F.col("fiscal_year") % 2 == 1), "").otherwise(F.col("n").cast("string"))).drop("n")
    before = now.select("company", (F.col("fiscal_year") + 1).alias("fiscal_year"), "field", F.col("value").alias("prev"))
    return now.withColumnRenamed("value", "curr").join(before, ["company", "fiscal_year", "field"], "full")


FIELDS_SQL = """
f0 AS (SELECT o_custkey AS company, year(o_orderdate)::INTEGER AS y, o_orderstatus AS field, count(*) AS n FROM orders GROUP BY ALL),
f1 AS (SELECT company, y, field, CASE WHEN n = 1 AND y % 2 = 1 THEN '' ELSE n::VARCHAR END AS v FROM f0),
fields AS (SELECT coalesce(a.company, b.company) AS company, coalesce(a.y, b.y + 1) AS fiscal_year, coalesce(a.field, b.field) AS field, coalesce(a.v, '') AS curr, coalesce(b.v, '') AS prev
  FROM f1 a FULL JOIN f1 b ON a.company = b.company AND a.y = b.y + 1 AND a.field = b.field)
"""


@query(
    "k3_resolve",
    f"""WITH {FIELDS_SQL} SELECT company, fiscal_year, field,
      CASE WHEN field = 'P' THEN CASE WHEN curr <> '' THEN curr ELSE prev END WHEN curr = '' THEN prev ELSE curr END AS final,
      CASE WHEN field = 'P' THEN CASE WHEN curr <> '' THEN 'Current Value Present -> Used Current' ELSE 'Current Value Missing -> Used Previous' END
        WHEN prev <> '' AND curr = '' THEN 'Current Value Missing -> Used Previous' WHEN prev = '' AND curr = '' THEN 'Both Missing -> Left Blank'
        WHEN prev = '' THEN 'Previous Missing -> Used Current' WHEN prev = curr THEN 'Current Value Same -> Used Previous' ELSE 'Current Value Different -> Used Current' END AS reason FROM fields""",
)
def k3_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("field") == "P", "CURRENT").otherwise("PREVIOUS FLA UNLESS CHANGED")
    final, reason = comparison.resolve(rule, F.col("prev"), F.col("curr"))
    return _fields(spark, sf_dir).select("company", "fiscal_year", "field", final.alias("final"), reason.alias("reason"))


@query(
    "k6_strict_validation",
    f"""WITH {FIELDS_SQL}, r AS (SELECT fiscal_year, CASE WHEN curr = '' THEN 'missing' WHEN curr = prev THEN 'ok' ELSE 'mismatch' END AS severity FROM fields WHERE curr <> '' OR prev <> '')
    SELECT fiscal_year, severity, count(*) AS n FROM r GROUP BY 1, 2""",
)
def k6_strict_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = comparison.strict_validation(_fields(spark, sf_dir))
    return out.groupBy("fiscal_year", comparison.severity(F.col("reason")).alias("severity")).agg(F.count("*").alias("n"))
