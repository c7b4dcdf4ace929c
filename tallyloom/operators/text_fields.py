"""Fields that stand in the running text of a filing: dates, identifiers, head counts, key and value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.lookup import grams
from tallyloom.sources.shared import dealt, saved

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(" + "|".join(MONTHS) + ")"
#: The forms of a company's registration and tax numbers.
CIN, PAN = r"[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}", r"[A-Z]{5}\d{4}[A-Z]"


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def statement_date(text: Column) -> Column:
    """DD/MM/YYYY of the date behind a statement's heading, else of the first date; an unknown month counts as 03."""
    word = r"(?is)(?:as at|as on|year ended|for the year ended)\s+(?:the\s+)?"
    forms = [(word + rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH},?\s+(\d{{4}})", 1, 2), (word + rf"{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})", 2, 1)]
    forms += [(rf"(?is)(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH},?\s+(\d{{4}})", 1, 2), (rf"(?is){_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})", 2, 1)]
    number = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    made = []
    for pattern, day, month in forms:
        found = F.concat_ws("/", F.lpad(_group(text, pattern, day), 2, "0"), F.coalesce(F.try_element_at(number, F.lower(_group(text, pattern, month))), F.lit("03")), _group(text, pattern, 3))
        made.append(F.when(_group(text, pattern, 3).isNotNull(), found))
    return F.coalesce(*made)


def next_closing(date: Column) -> Column:
    """The same day of the next year, of DD/MM/YYYY."""
    year = F.substring(date, 7, 4).try_cast("int") + 1
    return F.when(date.rlike(r"^\d\d/\d\d/\d{4}$"), F.concat(F.substring(date, 1, 6), year.cast("string")))


def company_ids(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, cin, pan and is_listed (by the first letter of the number); null where the text has none."""
    cin = F.regexp_substr("text", F.lit(CIN))
    return docs.select(*keys, cin.alias("cin"), F.regexp_substr("text", F.lit(rf"\b{PAN}\b")).alias("pan"), F.when(cin.startswith("L"), "yes").when(cin.startswith("U"), "no").alias("is_listed"))


def headcount(text: Column) -> Column:
    """fy and py: male, female and other added up (py the same); else a total close behind the word employees (py three fewer, at least 0); else the first number of employees."""
    n = lambda p: _group(text, rf"(?is){p}", 1).try_cast("long")
    three = n(r"\bmale[^0-9]{0,20}(\d+)") + n(r"\bfemale[^0-9]{0,20}(\d+)") + F.coalesce(n(r"\bother[^0-9]{0,20}(\d+)"), F.lit(0))
    total = n(r"employees.{0,150}?total[^0-9]{0,20}(\d+)")
    first = n(r"(?:payroll|employees)[^0-9]{0,40}(\d+)")
    return F.struct(F.coalesce(three, total, first).alias("fy"), F.coalesce(three, F.when(total.isNotNull(), F.greatest(F.lit(0), total - 3)), first).alias("py"))


def key_values(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, line_no, key and value of lines such as ``**Name** : x`` or ``1.a Name : x``; the value may be empty."""
    lines = docs.select(*keys, F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    bold, numbered = r"^\s*\*\*(.+?)\*\*\s*:\s*(.*?)\s*$", r"^\s*\d+\.?[a-z]?\s+([^:]+?)\s*:\s*(.*?)\s*$"
    kind = F.when(F.col("line").rlike(bold), 1).when(F.col("line").rlike(numbered), 2)
    pick = lambda i: F.when(F.col("kind") == 1, F.regexp_extract("line", bold, i)).otherwise(F.regexp_extract("line", numbered, i))
    return lines.withColumn("kind", kind).filter("kind is not null").select(*keys, (F.col("at") + 1).alias("line_no"), pick(1).alias("key"), pick(2).alias("value"))


def related_balances(investors: DataFrame, rows: DataFrame) -> DataFrame:
    """filing_id, name, payable and receivable: the greatest amount of the related-party rows that name an investor.

    rows has filing_id, row_no, text and amount. The block opens at a row that says related party;
    rows that say payable or receivable turn the side for what follows. An investor is named by any
    word of more than two letters of its name, legal forms aside; a word may stand inside a longer one.
    A row counts for each run of letters and digits in its text, and of equal runs of a filing only
    the greatest amounts go on. Words meet equal runs by filing and text, and longer runs by the three
    letters of the word that fewest of these have; only runs longer than the filing's shortest word
    are taken to pieces, and what meets is confirmed: no row meets all investors of its filing.
    """
    by = Window.partitionBy("filing_id").orderBy("row_no")
    low = F.lower("text")
    side = F.last(F.when(low.contains("payable"), "payable").when(low.contains("receivable"), "receivable"), ignorenulls=True).over(by)
    open_ = F.max(low.contains("related party")).over(by)
    block = rows.withColumn("side", side).withColumn("open", open_).filter("open and side is not null and amount is not null")
    words = F.filter(F.split(F.regexp_replace(F.lower("name"), "[^a-z0-9# ]", " "), " +"), lambda w: (F.length(w) > 2) & ~w.isin("ltd", "limited", "inc", "pte", "llp", "private", "pvt"))
    greatest = lambda s: F.max(F.when(F.col("side") == s, F.col("amount"))).alias(s)
    larger = lambda: [F.max(s).alias(s) for s in ("payable", "receivable")]
    # a text has a word only within one run of such letters
    runs = block.select("filing_id", "side", "amount", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9#]{3,}"), 0))).alias("run"))
    runs = saved(runs.groupBy("filing_id", "run").agg(greatest("payable"), greatest("receivable")), "runs")
    of_name = saved(investors.select("filing_id", "name", F.explode(F.array_distinct(words)).alias("word")), "words")
    equal = of_name.select("filing_id", "name", F.col("word").alias("run")).join(dealt(runs), ["filing_id", "run"]).select("filing_id", "name", "payable", "receivable")
    shortest = of_name.groupBy("filing_id").agg(F.min(F.length("word")).alias("least"))
    longer = saved(runs.join(dealt(shortest), "filing_id").filter(F.length("run") > F.col("least")).drop("least"), "longer")
    longest = longer.groupBy("filing_id").agg(F.max(F.length("run")).alias("most"))
    within = of_name.join(dealt(longest), "filing_id").filter(F.length("word") < F.col("most")).select("filing_id", "word").distinct()
    index = longer.select("filing_id", "run", F.explode(grams(F.col("run"), 3)).alias("gram"))
    often = index.groupBy("filing_id", "gram").agg(F.count("*").alias("n"))
    own = within.select("filing_id", "word", F.explode(grams(F.col("word"), 3)).alias("gram"))
    rarest = own.join(dealt(often), ["filing_id", "gram"]).groupBy("filing_id", "word").agg(F.min(F.struct("n", "gram")).alias("r"))
    pairs = rarest.select("filing_id", "word", "r.gram").join(dealt(index), ["filing_id", "gram"]).filter(F.col("run").contains(F.col("word")) & (F.col("run") != F.col("word")))
    best = pairs.select("filing_id", "word", "run").join(dealt(longer), ["filing_id", "run"]).groupBy("filing_id", "word").agg(*larger())
    inside = best.join(dealt(of_name), ["filing_id", "word"]).select("filing_id", "name", "payable", "receivable")
    return equal.union(inside).groupBy("filing_id", "name").agg(*larger())
