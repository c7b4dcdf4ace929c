"""Files of a corpus: roles, kinds, coverage, and what other tools have made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a file name that make it financial statements.
FINANCIAL = ["financial", "merged", "auditor", "audit", "notes", "account", "balance", "statement"]
#: Kinds of documents, words of their names, phrases of their texts, in the order of the tests.
KINDS = [
    ("board_resolution", ["ctc", "board resolution", "bm signed", "agm auditor"], ["certified true copy", "board resolution", "ctc bm", "ctc agm", "meeting of the board of directors", "resolved that", "board meeting", "extract of the resolution"]),
    ("consent_letter", ["consent", "appointment letter", "appointment ltr"], ["consent and eligibility", "consent letter", "appointment as statutory auditor", "appointment letter", "eligibility certificate", "we hereby give our consent", "subject: appointment", "sub: appointment"]),
    ("auditor_certificate", ["auditor cert", "certificate merged", "auditor certificate"], ["auditor certificate", "certificate of auditor", "to whomsoever it may concern", "certificate under section", "statutory auditor certificate"]),
]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, company (the file's name without FS_ and from _FY on) and text of every markdown file below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    name = F.regexp_replace(F.element_at(F.split("__path", "/"), -1), r"\.md$", "")
    company = F.regexp_replace(F.regexp_replace(name, "^FS_", ""), "_FY.*$", "")
    return files.withColumn("__path", F.col("_metadata.file_path")).select(F.col("__path").alias("path"), company.alias("company"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file below a folder, without hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.filter(~F.col("path").rlike(r"/(?:\.|venv/)"))


def _has(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in words])


def classify(name: Column, text: Column) -> Column:
    """The kind of a document by its name and then its text, kind by kind; else generic."""
    n = F.translate(F.lower(F.coalesce(name, F.lit(""))), "-_", "  ")
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("generic")
    for kind, in_name, in_text in reversed(KINDS):
        out = F.when(_has(n, in_name) | _has(t, in_text), kind).otherwise(out)
    return out


def assign_roles(files: DataFrame) -> DataFrame:
    """filing_id, role and path from rows of filing_id, listing_no and path.

    A file may be a board report or financial statements and, apart from that, a register, overseas
    or extra details. Of several files the last in the listing has the role; statements are numbered,
    documents and workbooks before PDF files, which only count without these.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    readable, sheet = F.col("path").rlike(r"\.(pdf|md|docx|doc|xlsx|xls|xlsm)$"), F.col("path").rlike(r"\.(xlsx|xls|xlsm|md|pdf)$")
    first = F.when(readable & name.contains("board"), "board_report").when(readable & ~name.contains("odi") & _has(name, FINANCIAL), F.when(F.col("path").endswith(".pdf"), "financials_pdf").otherwise("financials"))
    second = F.when(sheet & name.contains("shareholder"), "shareholders_fdi").when(sheet & name.contains("odi"), "odi_details").when(sheet & _has(name, ["details", "extra"]), "extra_details")
    rows = files.select("filing_id", "listing_no", "path", F.explode(F.array_compact(F.array(first, second))).alias("role"))
    single = rows.filter(~F.col("role").isin("financials", "financials_pdf")).groupBy("filing_id", "role").agg(F.max_by("path", "listing_no").alias("path"))
    by = Window.partitionBy("filing_id")
    best = F.min("role").over(by)  # documents sort before PDF files
    many = rows.filter(F.col("role").isin("financials", "financials_pdf")).withColumn("best", best).filter("role = best")
    many = many.withColumn("n", F.row_number().over(by.orderBy("listing_no")) - 1)
    return single.union(many.select("filing_id", F.concat(F.lit("financials_"), F.col("n").cast("string")), "path"))


def template_fields(words: DataFrame) -> DataFrame:
    """doc_id, label and field_id of a form: words left of 45 percent of the page, joined by bands of 8 points, without short lines, numbers and marks; the first place of a label counts."""
    band = F.bround(F.col("top") / 8, 0) * 8
    rows = words.filter(F.col("x0") < 0.45 * F.col("page_width")).groupBy("doc_id", "page", band.alias("band")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("x0", "text"))).getField("text"), " ").alias("label"))
    label = F.substring(F.trim("label"), 1, 120)
    noise = (F.length("label") < 4) | F.translate("label", ",.-", "").rlike("^[0-9]+$") | F.lower("label").rlike("^(refer instruction|all fields marked|pursuant to|llp form no|m2)") | F.col("label").rlike("[✔✓]")
    seen = rows.withColumn("label", label).filter(~noise).groupBy("doc_id", "label").agg(F.min(F.struct("page", "band")).alias("at"))
    slug = F.substring(F.regexp_replace(F.lower("label"), "[^a-z0-9_]", ""), 1, 50)
    return seen.select("doc_id", "label", F.concat(F.lit("field_"), slug).alias("field_id"), F.col("at.page").alias("page"))


def flatten_predictions(raw: DataFrame) -> DataFrame:
    """doc_id, key and value of predictions in JSON: an object's scalar entries, or a list of objects with key and value, bare or under data, fields or items.

    Texts that are not JSON give nothing.
    """
    parsed = raw.select("doc_id", F.try_parse_json("raw").alias("v"))
    wrapped = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "variant") for k in ("data", "fields", "items")], F.col("v"))
    entries = parsed.select("doc_id", wrapped.alias("v")).filter("v is not null").lateralJoin(_exploded(raw.sparkSession))
    pick = lambda *names: F.coalesce(*[F.try_variant_get("value", f"$.{n}", "string") for n in names])
    listed = F.col("key").isNull()
    key = F.when(listed, pick("key", "field", "label", "name")).otherwise(F.col("key"))
    value = F.when(listed, pick("value", "val", "amount")).otherwise(F.try_variant_get("value", "$", "string"))
    return entries.select("doc_id", key.alias("key"), value.alias("value")).filter("key is not null and value is not null")


def _exploded(spark: SparkSession) -> DataFrame:
    return spark.tvf.variant_explode(F.col("v").outer())


def manifest_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """filing_id, role, path and there, for the roles that a filing's manifest names.

    manifests: filing_id, folder and raw (JSON of role to a path below the folder), in the filing's
    folder or the one above; the one in the longest folder counts. What is no JSON object names
    nothing. there: is it one of the files (path)? Misses are kept to be reported.
    """
    named = manifests.filter("raw is not null").groupBy("filing_id").agg(F.max_by(F.struct("folder", "raw"), F.struct(F.length("folder"), "folder")).alias("m"))
    each = named.select("filing_id", "m.folder", F.explode(F.from_json("m.raw", "map<string,string>")).alias("role", "below")).filter("below is not null")
    found = each.select("filing_id", "role", F.concat_ws("/", "folder", "below").alias("path"))
    return found.join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").select("filing_id", "role", "path", F.coalesce("there", F.lit(False)).alias("there"))


def fill_roles(roles: DataFrame, files: DataFrame) -> DataFrame:
    """filing_id, role and path: the roles given, and those that a filing lacks from its files, in the order of their listing.

    files: filing_id, path and listing_no. Without a board report the first PDF is it, without
    financials the second PDF, else the first markdown, else the first workbook. All markdown files
    and workbooks without a role are added as fallback_md_0 and on, and fallback_xl_0 and on. Files
    are numbered within their filing and kind; only filings' own files meet.
    """
    low = F.col("path")
    kind = F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".md"), "md").when(low.endswith(".xlsx") | low.endswith(".xls"), "xl")
    rows = files.withColumn("kind", kind).filter("kind is not null")
    nth = F.row_number().over(Window.partitionBy("filing_id", "kind").orderBy("listing_no")) - 1
    rows = rows.withColumn("nth", nth)
    has = roles.groupBy("filing_id").agg(F.max(F.col("role") == "board_report").alias("board"), F.max(F.col("role").isin("financials", "financials_0")).alias("money"))
    state = rows.join(has, "filing_id", "left").na.fill(False, ["board", "money"])
    pick = lambda k, n: F.max(F.when((F.col("kind") == k) & (F.col("nth") == n), F.col("path")))
    first = state.groupBy("filing_id", "board", "money").agg(pick("pdf", 0).alias("p0"), F.coalesce(pick("pdf", 1), pick("md", 0), pick("xl", 0)).alias("second"))
    role = lambda test, name, path: F.when(test & F.col(path).isNotNull(), F.struct(F.lit(name).alias("role"), F.col(path).alias("path")))
    added = first.select("filing_id", F.inline(F.array_compact(F.array(role(~F.col("board"), "board_report", "p0"), role(~F.col("money"), "financials", "second")))))
    all_ = roles.select("filing_id", "role", "path").union(added)
    loose = rows.filter("kind <> 'pdf'").join(all_.select("filing_id", "path").distinct(), ["filing_id", "path"], "left_anti")
    return all_.union(loose.select("filing_id", F.concat(F.lit("fallback_"), "kind", F.lit("_"), F.col("nth").cast("string")).alias("role"), "path"))


def ocr_coverage(docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """filing_id, path, output and coverage of each document of filings.

    docs: filing_id and path. outputs: filing_id and path of OCR output below the filing's folder of
    output. name/name.md is preferred to name.md. A markdown file or workbook is structured, a PDF
    with an output cached, else missing; others are native.
    """
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    name = docs.withColumn("base", base)
    out = outputs.select("filing_id", F.col("path").alias("output"))
    parts = F.split("output", "/")
    last, above = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_replace(last, r"\.md$", "")
    placed = out.filter(last.endswith(".md")).select("filing_id", stem.alias("base"), F.struct((~F.coalesce(above == stem, F.lit(False))).alias("flat"), "output").alias("o"))
    best = placed.groupBy("filing_id", "base").agg(F.min("o").alias("o"))
    met = name.join(best, ["filing_id", "base"], "left")
    kind = F.when(F.lower("path").rlike(r"\.(md|xlsx?)$"), "structured").when(~F.lower("path").endswith(".pdf"), "native").when(F.col("o").isNotNull(), "cached").otherwise("missing")
    return met.select("filing_id", "path", F.when(kind == "cached", F.col("o.output")).alias("output"), kind.alias("coverage"))
