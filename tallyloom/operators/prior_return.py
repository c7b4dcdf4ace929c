"""The previous return: what its text says by key, and what a template's fields take over from it.

prior_fields reads a return's markdown in its row; what is then grouped is one row for each key. The
template is small and the same for all filings, so it travels as one row; everything else meets by
filing, or by filing and cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once, places
from tallyloom.functions.cleaning import null_text, placeholder_to_blank
from tallyloom.operators import comparison, header_scan, lookup
from tallyloom.operators.table_markup import loose_tables
from tallyloom.sources.shared import dealt, saved

_BEHIND = r".*?(?::|[ \t]{2,})[ \t]*(.*)"
#: Fields of a return and the patterns that find them in its text.
PATTERNS = [
    ("1. Name of the Indian Company", r"1\.\s*Name of the Indian Company" + _BEHIND), ("2. PAN number*", r"2\.\s*PAN Number" + _BEHIND), ("3. CIN number*", r"3\.\s*CIN Number" + _BEHIND),
    ("Name of the Contact Person", r"Name of the Contact Person" + _BEHIND), ("Telephone No. (with extension)", r"Telephone [Nn]o" + _BEHIND), ("Mobile Number*", r"Mobile (?:No|Number)" + _BEHIND),
    ("E-Mail ID (Head of the institution)", r"E-?mail \(Head of institution\)" + _BEHIND), ("E-Mail of Contact person*", r"E-?mail of Contact Person" + _BEHIND), ("Designation*", r"Designation" + _BEHIND),
    ("Website (if any)", r"Website \(if any\)" + _BEHIND), ("Account Closing date*", r"5\.\s*Account closing date" + _BEHIND),
    ("Whether your company is merged / amalgamated during the year*", r"7\.\s*Whether your company is merged" + _BEHIND), ("Whether the company is listed?*", r"8\.\s*Whether the Company is listed" + _BEHIND),
    ("No. of foreign direct investors during the year (10% or more Equity participation)", r"1\.a\s*No\. of foreign direct investors.*?(\d+)"),
    ("Month and Year of receiving FDI first time (in your company)", r"1\.a\.1\s*Month and Year of receiving FDI first time.*?:\s*(.*)"),
    ("Number of countries (with less than 10% Equity holding) from each during the year", r"2\.a\s*Number of countries \(with less than 10% Equity holding\).*?(\d+)"),
    ("No. of Direct Investment Enterprises (DIE) Abroad as on end-March 2021", r"1\.a\s*No\. of Direct Investment Enterprises \(DIE\) Abroad.*?(\d+)"),
    ("Month and Year of ODI made first time (by your company)", r"1\.a\.\s*Month and Year.*?ODI made first time.*?:\s*(.*)"),
    ("Total Equity of DIE (Paid Up Capital of DIE)", r"Total Equity of DIE \(Paid Up Capital of DIE\).*?(\d+)"), ("Equity of DIE held by you (at face value)", r"Equity of DIE held by you \(at face value\).*?(\d+)"),
    ("Liabilities to Direct Investment Enterprise", r"1\.1\s*Liabilities to Direct Investment Enterprise.*?(\d+)"),
    ("No. of Countries where your company holds less than 10 % equity shares in each under the ODI Scheme", r"2\.a\s*No\. of Countries where your company holds less than 10 % equity shares.*?(\d+)"),
]
#: The name of a field that later steps ask for, and the names that returns give it.
ALIASES = [
    ("Telephone No. (with extension)", ["Telephone no. (with extension)", "Telephone No. (with extension)", "Telephone no.(with extension)"]), ("Mobile Number", ["Mobile No", "Mobile no", "Mobile Number"]),
    ("E-Mail ID (Head of the institution)", ["Email (Head of institution)", "Email (Head of the institution)", "E-Mail ID (Head of the institution)", "E-mail ID (Head of the institution)*"]),
    ("E-Mail of Contact person", ["Email of Contact Person", "Email of Contact person", "E-Mail of Contact person", "E-mail of Contact Person", "E-Mail of Contact person*"]),
    ("Name of the Contact Person", ["Name of the Contact Person", "Name of Contact Person"]), ("Designation", ["Designation", "Designation*"]),
    ("Website (if any)", ["Website (if any)", "Website(if any)", "Website", "website", "Website (If any)", "Website (if Any)"]), ("2. PAN number", ["2. PAN Number", "2. PAN number", "PAN Number", "PAN number"]),
    ("Type of company", ["(ii) Type of the company", "Type of the company", "Type of company"]),
    ("Identification of reporting company", ["9 (i) Identification of the reporting Company (in terms of inward FDI)", "9(i) Identification of the reporting Company", "Identification of reporting company"]),
    ("Whether your company is merged/amalgamated during year", ["7. Whether your company is merged/amalgamated during year", "Whether your company is merged / amalgamated during the year", "Whether your company is merged/amalgamated during year"]),
    ("Whether the company is listed?", ["8. Whether the Company is listed?", "Whether the Company is listed?", "Whether the company is listed?"]),
    ("Whether the Company is Asset Management Company?", ["10. Whether the Company is Asset Management Company?", "Whether the Company is Asset Management Company?"]),
    ("Whether the Company has Technical Foreign collaboration?", ["11. Whether the Company has Technical Foreign collaboration?", "Whether the Company has Technical Foreign collaboration?"]),
    ("Whether the company has any business activity?", ["12. Whether the company has any business activity during latest financial year?", "Whether the company has any business activity?"]),
    ("Account Closing date*", ["5. Account closing date", "Account closing date", "Account Closing date"]),
]
#: Items that are headings of a table's parts.
HEADINGS = ("item", "type of capital", "portfolio investments", "")
#: Fields that always take the previous return's value, and the words of rules that do.
IDENTITY = ("NAME OF THE INDIAN COMPANY", "PAN NUMBER", "CIN NUMBER", "E-MAIL ID (HEAD OF THE INSTITUTION)")
PREFILL, UNLESS, STRICT = "PREFILL FROM PREVIOUS FLA", "PREVIOUS FLA UNLESS THERE IS A CHANGE", "PY Column -> STRICTLY Used Previous FLA"


def stated(docs: DataFrame) -> DataFrame:
    """filing_id, ord, key and value of lines such as ``**Name** : x`` and ``1.a Name : x``; of a bold key the value may be empty."""
    bold, numbered = r"\*\*(.+?)\*\*[ \t]*:[ \t]*(.*)", r"^\s*(\d+\.[\w.]*)\s+(.+?)\s*:\s*(.+)"
    plain = lambda c: F.trim(F.replace(c, F.lit("<br>"), F.lit(" ")))
    line = docs.select("filing_id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    kind = F.when(F.col("line").rlike(numbered), 1).when(F.col("line").rlike(bold), 0)
    part = lambda p, i: F.regexp_extract("line", p, i)
    key = F.when(F.col("kind") == 0, plain(part(bold, 1))).otherwise(F.concat_ws(" ", part(numbered, 1), plain(part(numbered, 2))))
    value = F.when(F.col("kind") == 0, plain(part(bold, 2))).otherwise(plain(part(numbered, 3)))
    # numbered lines are read after all bold ones
    order = F.col("kind") * F.lit(1 << 40) + F.col("at")
    return line.withColumn("kind", kind).filter("kind is not null").select("filing_id", order.alias("ord"), key.alias("key"), value.alias("value"))


def pattern_fields(docs: DataFrame) -> DataFrame:
    """filing_id, key and value of the fields of PATTERNS that a text states; what stands for nothing is left out."""
    found = [F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract("text", f"(?im){p}", 1)).alias("value"), F.col("text").rlike(f"(?im){p}").alias("there")) for k, p in PATTERNS]
    each = docs.select("filing_id", F.explode(F.filter(F.array(*found), lambda x: x["there"] & ~F.lower(x["value"]).isin("nan", "none", "null"))).alias("f"))
    return each.select("filing_id", "f.key", "f.value")


def _year_columns(headers: Column, rows: Column) -> Column:
    """item, fy and py: the column of the items, and those of the later and the earlier year, by the headers, else by the first of the first three rows that names a year."""
    top = F.slice(rows, 1, 3)
    years = F.sort_array(F.array_distinct(F.flatten(F.transform(F.concat(headers, F.flatten(top)), lambda c: F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), 1)))))

    def by(year: Column) -> Column:
        fy = F.when(F.size(year) > 1, F.try_element_at(year, F.lit(-1))).otherwise("2025")
        py = F.when(F.size(year) > 1, F.try_element_at(year, F.lit(-2))).otherwise("2024")
        of = lambda cells: F.named_struct(
            F.lit("item"), F.array_max(F.transform(cells, lambda c, i: F.when(F.lower(c).contains("item") | F.lower(c).contains("type"), i))),
            F.lit("fy"), F.filter(places(cells), lambda i: F.get(cells, i).contains(fy) & ~F.get(cells, i).contains(py)), F.lit("py"), F.filter(places(cells), lambda i: F.get(cells, i).contains(py)),
        )
        named = lambda x: (F.size(x["fy"]) > 0) | (F.size(x["py"]) > 0)

        def choose(each: Column) -> Column:
            """The header's columns, or those of the first row with a year; the item's column may be named in any row up to it."""
            head = F.get(each, F.lit(0))
            first = F.array_min(F.transform(each, lambda x, i: F.when(named(x), i)))
            looked = F.when(named(head), F.slice(each, 1, 1)).otherwise(F.slice(each, 1, F.coalesce(first, F.size(each)) + 1))
            item = F.try_element_at(F.array_compact(F.transform(looked, lambda x: x["item"])), F.lit(-1))
            best = F.coalesce(F.get(each, first), head)
            return F.named_struct(F.lit("item"), F.coalesce(item, F.lit(0)), F.lit("fy"), best["fy"], F.lit("py"), best["py"])

        return once(F.concat(F.array(of(headers)), F.transform(top, lambda r: of(r))), choose)

    return once(years, by)


def table_fields(docs: DataFrame) -> DataFrame:
    """filing_id, ord, key and value of a return's tables: an item's later year under its name, the earlier under ``__PY``; of two columns a year the first is of shares, ``__shares``."""
    tables = loose_tables(docs.select(F.col("filing_id").alias("doc_id"), "text")).filter((F.size("headers") > 0) & (F.size("rows") > 0))
    placed = tables.select(F.col("doc_id").alias("filing_id"), "table_no", _year_columns(F.col("headers"), F.col("rows")).alias("c"), F.posexplode("rows").alias("row_no", "row"))
    item = F.trim(F.replace(F.get("row", F.col("c.item")), F.lit("<br>"), F.lit(" ")))
    named = placed.withColumn("name", item).filter(F.col("name").isNotNull() & ~F.lower("name").isin(*HEADINGS))

    def cells(year: str, last: str) -> Column:
        columns = F.col(f"c.{year}")
        suffix = lambda i: F.when((F.size(columns) == 2) & (i == 0), f"__shares{last}").otherwise(last)
        said = F.transform(columns, lambda c, i: F.struct(i.alias("nth"), F.concat("name", suffix(i)).alias("key"), F.trim(F.get("row", c)).alias("value")))
        return F.filter(said, lambda x: F.coalesce(x["value"], F.lit("")) != "")

    each = named.select("filing_id", "table_no", "row_no", F.posexplode(F.concat(cells("fy", ""), cells("py", "__PY"))).alias("nth", "f"))
    order = F.col("table_no") * F.lit(1 << 40) + F.col("row_no") * F.lit(1 << 12) + F.col("nth")
    return each.select("filing_id", order.alias("ord"), "f.key", "f.value")


def prior_fields(docs: DataFrame) -> DataFrame:
    """filing_id, ord, key and value of previous returns (filing_id and text): one row for each key.

    Lines with a key count first, of repeated ones the last; then PATTERNS; then tables, of repeated
    keys the first. Names of ALIASES come on top where they are missing, from the first of their
    variants that is there. ord is the place in which a reader would meet the key.
    """
    part = lambda df, rank, order: df.select("filing_id", "key", F.struct(F.lit(rank).alias("rank"), order.cast("long").alias("order")).alias("at"), F.lit(rank * (1 << 52)).cast("long").alias("base"), "ord", "value")
    lines, tables = stated(docs), table_fields(docs)
    nth = reduce(lambda acc, x: F.when(F.col("key") == x[1][0], x[0]).otherwise(acc), enumerate(PATTERNS), F.lit(0))
    patterns = pattern_fields(docs).withColumn("ord", nth)
    all_ = part(lines, 0, -F.col("ord")).union(part(patterns, 1, F.col("ord"))).union(part(tables, 2, F.col("ord")))
    own = saved(all_.groupBy("filing_id", "key").agg(F.min(F.col("base") + F.col("ord")).alias("ord"), F.min_by("value", "at").alias("value")), "fields")
    variants = docs.sparkSession.createDataFrame([(v, c, i, j) for i, (c, vs) in enumerate(ALIASES) for j, v in enumerate(vs)], "key string, canonical string, alias_no int, variant_no int")
    named = own.join(variants, "key").groupBy("filing_id", "canonical", "alias_no").agg(F.min_by("value", "variant_no").alias("value"), F.max(F.col("key") == F.col("canonical")).alias("there"))
    added = named.filter("not there").select("filing_id", F.lit(3 * (1 << 52)).cast("long") + F.col("alias_no"), F.col("canonical").alias("key"), "value")
    return own.select("filing_id", "ord", "key", "value").union(added)


def template_rows(cells: DataFrame) -> DataFrame:
    """sheet, row_no, way, field, rule and slots of a template's rows that ask for something.

    way is ``source`` for a row with a source of information (rule: what it says), and ``years`` for a
    row below a header of years, with slots: label, is_share and col_no of the columns to be filled.
    Headers of years are carried down until the next one. Rows of totals and of what is calculated
    ask for nothing.
    """
    columns = header_scan.template_columns(cells)
    rows = cells.groupBy("sheet", "row_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("value", F.lit("")).alias("value"))))).alias("v")).join(columns, "sheet")
    at = lambda c: null_text(F.try_element_at("v", c))
    below = F.col("row_no") > F.col("head_row")
    rule = F.upper(at(F.col("source")))
    identity = reduce(Column.__or__, [F.upper(at(F.col("field"))).contains(w) for w in IDENTITY])
    rule = F.when(identity, PREFILL).otherwise(rule)
    in_scope = (F.col("sheet") == "Section I") | ((F.col("sheet") == "Section II") & (F.col("row_no") >= 24)) | (F.col("sheet") == "Section III")
    asks = rows.filter(F.col("field").isNotNull() & F.col("source").isNotNull() & below & in_scope & (at(F.col("field")) != ""))
    asks = asks.select("sheet", "row_no", F.lit("source").alias("way"), at(F.col("field")).alias("field"), rule.alias("rule")).filter(F.col("rule").contains("PREVIOUS FLA") | F.col("rule").contains("PREFILL"))

    said = F.transform(F.map_entries("v"), lambda e: F.struct(e["key"].alias("col"), F.lower(F.trim(e["value"])).alias("text")))
    heads = lambda word: F.transform(F.filter(said, lambda x: x["text"].contains(word)), lambda x: x["col"])
    several = lambda found: F.when(F.size(found) > 1, F.try_element_at(found, F.lit(-1)))
    opens = F.exists(said, lambda x: x["text"].isin("end march py", "end march fy"))
    own = F.when(opens, F.struct(*[f(heads(f"end march {y}")).alias(f"{y}_{n}") for y in ("py", "fy") for n, f in (("share", lambda h: F.get(h, F.lit(0))), ("amount", several))]))
    by = Window.partitionBy("sheet").orderBy("row_no")
    first = F.struct(*[F.col(f"{y}_{n}").alias(f"{y}_{n}") for y in ("py", "fy") for n in ("share", "amount")])
    state = rows.select("*", opens.alias("opens"), F.coalesce(F.last(own, ignorenulls=True).over(by), first).alias("now"))
    name = F.coalesce(*[F.nullif(at(c), F.lit("")) for c in (F.col("field"), F.lit(0), F.lit(2))])
    low = F.lower("name")
    filled = state.filter("not opens and field is not null").filter(below & (F.col("now.py_share").isNotNull() | F.col("now.fy_share").isNotNull())).withColumn("name", name).filter("name is not null")
    filled = filled.filter(~(low.contains("auto-calculated") | low.isin("total", "total (in inr)") | low.startswith("total:")))
    narrow = (F.col("sheet") == "Section II") & (F.col("row_no") >= 25)
    slot = lambda label, year, share, column, always: F.when(F.col(f"now.{column}").isNotNull() & (F.lit(always) | ~narrow), F.struct(F.lit(label).alias("label"), F.lit(year).alias("year"), F.lit(share).alias("is_share"), F.col(f"now.{column}").alias("col_no")))
    slots = F.array_compact(F.array(slot("PY Shares/Col1", "PY", True, "py_share", False), slot("PY Amount/Col2", "PY", False, "py_amount", True), slot("FY Shares/Col1", "FY", True, "fy_share", False), slot("FY Amount/Col2", "FY", False, "fy_amount", False)))
    years = filled.filter(F.col("sheet").isin("Section II", "Section III") & ((F.col("sheet") == "Section III") | (F.col("row_no") >= 4))).select("sheet", "row_no", F.lit("years").alias("way"), F.col("name").alias("field"), F.lit(None).cast("string").alias("rule"), slots.alias("slots"))
    return asks.withColumn("slots", F.lit(None).cast(years.schema["slots"].dataType)).unionByName(years)


def against_template(template: DataFrame, prior: DataFrame, grid: DataFrame) -> DataFrame:
    """filing_id, sheet, row_no, field, mapping, previous, current, final and reason: what each filing's grid takes over from its previous return.

    template: cells (sheet, row_no, col_no, value) of the one template. prior: prior_fields. grid:
    filing_id, sheet, row_no, col_no and value of this year's cells; filings are those of either.
    A ``source`` row looks at the column of particulars (the grid's, else the third). Of a ``years``
    row the previous year's columns take last year's figures as they are in Section II; its rows 4 to
    23 resolve this year's columns, the rows below and Section III are held against them, amounts only.
    A column whose row the filing's sheet does not reach is left out.
    """
    rows, prior = saved(template_rows(template), "template"), saved(prior, "prior")
    filings = prior.select("filing_id").union(grid.select("filing_id")).distinct()
    asked = rows.agg(F.collect_list(F.struct("sheet", "row_no", "way", "field", "rule", "slots")).alias("rows"))  # one row
    each = filings.crossJoin(asked).select("filing_id", F.explode("rows").alias("r")).select("filing_id", "r.*")
    names = rows.select("field").union(rows.filter("way = 'years'").select(F.concat("field", F.lit("__shares")))).distinct()
    known = saved(lookup.lookup(prior, names).select("filing_id", F.col("field").alias("of"), null_text(F.col("value")).alias("previous")), "known")
    last_rows = grid.groupBy("filing_id", "sheet").agg(F.max("row_no").alias("last_row"))
    cells = grid.select("filing_id", "sheet", F.col("row_no").alias("row_no"), F.col("col_no"), null_text(F.col("value")).alias("said"))

    particulars = grid.filter((F.col("row_no") < header_scan.TEMPLATE_SCANNED) & F.lower(F.trim("value")).isin("particulars", "value"))
    particulars = particulars.groupBy("filing_id", "sheet").agg(F.min(F.struct(-F.col("row_no"), F.col("col_no").alias("col_no"))).alias("p")).select("filing_id", "sheet", F.col("p.col_no").alias("write_col"))
    key = ["filing_id", "sheet", "row_no", "col_no"]
    a = each.filter("way = 'source'").join(dealt(particulars), ["filing_id", "sheet"], "left").withColumn("col_no", F.coalesce("write_col", F.lit(2)))
    a = a.join(dealt(cells), key, "left").join(dealt(known.toDF("filing_id", "field", "previous")), ["filing_id", "field"], "left")
    a = a.withColumns({"previous": F.coalesce("previous", F.lit("")), "current": placeholder_to_blank(F.coalesce("said", F.lit("")))})
    final, reason = comparison.resolve(F.col("rule"), F.col("previous"), F.col("current"))
    by_source = a.select("filing_id", "sheet", "row_no", "field", F.col("rule").alias("mapping"), "previous", "current", final.alias("final"), reason.alias("reason"))

    b = each.filter("way = 'years'").select("filing_id", "sheet", "row_no", "field", F.explode("slots").alias("s")).select("filing_id", "sheet", "row_no", "field", "s.*")
    b = b.join(dealt(last_rows), ["filing_id", "sheet"]).filter(F.col("row_no") <= F.col("last_row")).join(dealt(cells), key, "left")
    amount = known.toDF("filing_id", "field", "amount")
    shares = known.filter(F.col("of").endswith("__shares")).select("filing_id", F.regexp_replace("of", "__shares$", "").alias("field"), F.col("previous").alias("shares"))
    b = b.join(dealt(amount), ["filing_id", "field"], "left").join(dealt(shares), ["filing_id", "field"], "left")
    fill = F.when(F.col("is_share"), F.coalesce(F.nullif("shares", F.lit("")), "amount")).otherwise(F.col("amount"))
    b = b.withColumns({"previous": F.coalesce(fill, F.lit("")), "said": F.coalesce("said", F.lit(""))})
    resolved = (F.col("sheet") == "Section II") & (F.col("row_no") < 24)
    strict = (F.col("year") == "PY") & (F.col("sheet") == "Section II")
    blanked = placeholder_to_blank(F.col("said"))
    final, reason = comparison.resolve(F.lit(UNLESS), F.col("previous"), blanked)
    p, c = F.col("previous") != "", F.col("said") != ""
    held = F.when(c & (F.col("said") == F.col("previous")), "Values Match Perfectly").when(~c, "Missing in Current -> Needs Review").otherwise("Mismatch Detected -> Needs Review")
    out = b.filter(resolved | (strict & p) | (~strict & ~F.col("is_share") & (p | c))).select(
        "filing_id", "sheet", "row_no", F.concat("field", F.lit(" ("), "label", F.lit(")")).alias("field"), F.when(strict, "STRICT PY").when(resolved, UNLESS).otherwise("STRICT_VALIDATION").alias("mapping"),
        F.when(resolved | strict | p, F.col("previous")).otherwise("Missing").alias("previous"), F.when(resolved, blanked).when(strict, "Ignored").when(c, F.col("said")).otherwise("Missing").alias("current"),
        F.when(strict, F.col("previous")).when(resolved, final).otherwise(F.col("said")).alias("final"), F.when(strict, STRICT).when(resolved, reason).otherwise(held).alias("reason"),
    )
    return by_source.union(out)
