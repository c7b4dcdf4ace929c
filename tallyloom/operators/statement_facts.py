"""Facts of statement tables: which column is the current year's, which the previous one's, and the amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once, places
from tallyloom.functions.cleaning import statement_number

CURRENT, PREVIOUS = r"(?i)current|\bfy\b|\bcy\b", r"(?i)previous|\bpy\b"


def period_columns(cells: DataFrame) -> DataFrame:
    """doc_id, block_no, col_no and period (fy or py) of each table.

    The greatest year among the headers is the current one and the next smaller the previous; without
    years, words in the headers tell; without these, the last two number columns are fy and py.
    """
    heads = cells.filter("row_no = 0").withColumn("year", F.regexp_extract("header", r"(?:^|[^0-9])((?:19|20)\d\d)(?:[^0-9]|$)", 1).try_cast("int"))
    by = Window.partitionBy("doc_id", "block_no")
    rank = F.dense_rank().over(by.orderBy(F.desc_nulls_last("year")))
    words = F.when(F.col("header").rlike(CURRENT), "fy").when(F.col("header").rlike(PREVIOUS), "py")
    numbers = cells.filter(F.col("row_no") > 0).groupBy("doc_id", "block_no", "col_no").agg(F.avg(F.col("value").rlike(r"^[(\d][\d,.)]*$|^[-—]$").cast("double")).alias("share"), F.max(F.col("value").rlike(r"\d{3}").cast("int")).alias("large"))
    placed = heads.join(numbers, ["doc_id", "block_no", "col_no"], "left").withColumn("number", (F.col("share") > 0.5) & (F.col("large") == 1))
    from_right = F.row_number().over(by.orderBy(F.desc("number"), F.desc("col_no")))
    any_year, any_word = F.max(F.col("year").isNotNull()).over(by), F.max(words.isNotNull()).over(by)
    period = F.when(any_year, F.when(F.col("year").isNotNull(), F.when(rank == 1, "fy").when(rank == 2, "py"))).when(any_word, words).when(F.col("number"), F.when(from_right == 1, "py").when(from_right == 2, "fy"))
    return placed.select("doc_id", "block_no", "col_no", period.alias("period")).filter("period is not null")


def statement_facts(cells: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no, item, fy and py: one row for each body row with a label and an amount column."""
    labels = cells.filter("row_no > 0 and col_no = 0").select("doc_id", "block_no", "row_no", F.col("value").alias("item"))
    amounts = cells.filter("row_no > 0").join(period_columns(cells), ["doc_id", "block_no", "col_no"])
    pairs = amounts.groupBy("doc_id", "block_no", "row_no").agg(*[F.max_by(statement_number(F.col("value")), F.when(F.col("period") == p, 1)).alias(p) for p in ("fy", "py")])
    return labels.join(pairs, ["doc_id", "block_no", "row_no"])


def _periods(rows: Column) -> Column:
    """fy and py: the column numbers of the current and the previous year of a table's rows, by the rules of period_columns; null if there is none."""
    head = F.get(rows, F.lit(0))
    body = F.slice(rows, 2, F.size(rows))
    year = lambda h: F.regexp_extract(h, r"(?:^|[^0-9])((?:19|20)\d\d)(?:[^0-9]|$)", 1).try_cast("int")
    word = lambda h: F.when(h.rlike(CURRENT), "fy").when(h.rlike(PREVIOUS), "py")

    def by_years(years: Column) -> Column:
        distinct = F.sort_array(F.array_distinct(F.array_compact(years)), asc=False)
        at = lambda k: F.array_position(years, F.get(distinct, F.lit(k)))
        last = lambda k: F.array_max(F.filter(places(years), lambda c: F.get(years, c) == F.get(distinct, F.lit(k))))
        return F.when(at(0).isNotNull(), F.struct(last(0).alias("fy"), last(1).alias("py")))

    def by_words(words: Column) -> Column:
        last = lambda p: F.array_max(F.filter(places(words), lambda c: F.get(words, c) == p))
        return F.when(F.exists(words, lambda w: w.isNotNull()), F.struct(last("fy").alias("fy"), last("py").alias("py")))

    def by_place(columns: Column) -> Column:
        return F.struct(F.get(columns, F.size(columns) - 2).alias("fy"), F.get(columns, F.size(columns) - 1).alias("py"))

    value = lambda r, c: F.get(r, c)
    share = lambda c: F.size(F.filter(body, lambda r: value(r, c).rlike(r"^[(\d][\d,.)]*$|^[-—]$"))) * 2 > F.size(body)
    large = lambda c: F.exists(body, lambda r: value(r, c).rlike(r"\d{3}"))
    numbers = F.filter(places(head), lambda c: share(c) & large(c))
    return F.coalesce(once(F.transform(head, year), by_years), once(F.transform(head, word), by_words), once(numbers, by_place))


def table_facts(tables: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no, item, fy and py for each body row, from whole tables (rows: arrays of cells, the header first).

    The same as statement_facts, without a join: a table with neither year nor number columns has no
    fact, an amount without its column is null.
    """
    with_periods = tables.withColumn("p", _periods(F.col("rows"))).filter("p.fy is not null or p.py is not null")
    each = with_periods.select("doc_id", "block_no", "p", F.posexplode("rows").alias("row_no", "row")).filter("row_no > 0")
    amount = lambda p: F.when(F.col(f"p.{p}").isNotNull(), statement_number(F.get("row", F.col(f"p.{p}")))).alias(p)
    return each.select("doc_id", "block_no", "row_no", F.get("row", F.lit(0)).alias("item"), amount("fy"), amount("py"))
