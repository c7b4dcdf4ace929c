"""Text disclosures: phrase and proximity checks over the lower-cased full text of a filing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of an audit report and the spellings that count.
AUDIT_HEADINGS = [
    ("Opinion", ["opinion"]), ("Basis for Opinion", ["basis of opinion", "basis for opinion"]), ("Emphasis of matter", ["emphasis of matter"]),
    ("Key Audit Matters", ["key audit matter"]), ("Other Information", ["other information"]),
    ("Responsibility of Management", ["responsibilities of management", "management's responsibility"]),
    ("Auditor's responsibility", ["auditor's responsibilities", "auditor's responsibility"]), ("Other matters", ["other matter"]),
    ("Report on other legal and regulatory requirements", ["other legal and regulatory requirements"]), ("Internal Financial Controls", ["internal financial control"]),
]
#: Checks that any one of these phrases satisfies.
ANY_PHRASE = {
    "reconciliation_of_shares": ["reconciliation", "shares at beginning of year", "shares at end of year", "number of equity shares outstanding at the end of the year", "number of equity shares outstanding at the beginning of the year"],
    "promoter_holding": ["promoter", "promoter holding", "promoter's holding", "shares held by promoter", "shares held by promoters", "name of promoters", "shareholding of promoters"],
    "accounting_policies": ["significant accounting policies"],
    "cash_flow_statement": ["cash flow statement", "statement of cash flows"],
}
#: Phrases of the audit trail; several lists must each have a phrase in the text.
AUDIT_TRAIL = {
    "software": [["audit trail", "edit log", "accounting software", "recording of audit trail", "feature of recording audit trail"]],
    "edit_log": [["edit log", "recording audit trail", "feature of recording audit trail"]],
    "throughout_year": [["operated throughout the year", "operated"], ["operated throughout the year", "throughout"]],
    "tampering": [["tampered with", "not tampered", "audit trail feature has not been tampered"]],
    "preservation": [["preserv", "retention"], ["audit trail"]],
}
#: Phrases of a forex disclosure, of related parties, and how far off a figure may be.
FOREX = ["value of imports", "c.i.f basis", "c.l.f basis", "expenditure in foreign currency", "earnings in foreign exchange", "foreign exchange", "foreign currency", "forex", "related party", "rpt"]
RELATED = ["related party", "rpt", "loan to directors", "loan from directors", "remuneration to kmp"]
#: Phrases of each disclosure of social responsibility, the first one present counts.
CSR = {
    "csr_required_amount": ["amount required to be spent", "required to be spent"],
    "csr_expenditure": ["expenditure incurred", "amount of expenditure"],
    "csr_shortfall": ["shortfall at the end", "shortfall"],
    "csr_previous_shortfall": ["previous years shortfall", "previous year shortfall"],
    "csr_shortfall_reason": ["reason for shortfall"],
    "csr_activities": ["nature of csr", "csr activities", "contribution towards"],
    "csr_trust": ["related party transactions", "contribution to a trust", "trust"],
    "csr_obligation": ["contractual obligation", "provision is made", "liability incurred"],
}
#: What tells that a statement has the previous year's figures.
PREVIOUS_YEAR = r"previous year|prior year|31st march 20\d\d|31\.03\.20\d\d"
#: Words whose disclosure needs a figure close by.
EPS = r"\b(?:eps|earnings per share|diluted eps|diluted earnings? per share)\b"
EPS_REACH, FIGURE_REACH = 100, 150
#: How far an amount may be off the registry's, at least and as a share of it; of last year's, likewise.
REGISTRY_OFF, YEAR_OFF = (1000.0, 0.01), (1.0, 0.01)
IMAGE = r"!\[.*?\]\(.*?\)"


def has_any(text: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in phrases])


def near(text: Column, word: str, other: str, reach: int) -> Column:
    """Does a match of the pattern word have one of the pattern other within so many characters?

    Both sides are looked at from the word's matches only.
    """
    return text.rlike(rf"(?s){word}(?:(?=.{{0,{reach - 1}}}?{other})|(?<={other}.{{0,{reach - 1}}}{word}))")


def literal(phrase: str) -> str:
    return rf"\Q{phrase}\E"


def within(a: Column, b: Column, off: tuple[float, float]) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(off[0]), off[1] * F.abs(b))


def missing(text: Column, wanted: list[tuple[str, list[str]]]) -> Column:
    return F.array_compact(F.array(*[F.when(~has_any(text, spellings), name) for name, spellings in wanted]))


def disclosure_flags(docs: DataFrame, keys: tuple[str, ...] = ("filing_id",), particulars: tuple[str, ...] = ()) -> DataFrame:
    """Keys, check, user_value, status and reason for every check of every filing with a column full_text.

    Yes is Passed, all else Failed; a null text counts as empty. These columns are used where docs
    has them, and otherwise count as null: small_company (a small one needs no cash flow statement),
    csr_applicable (false or null: its disclosures are not applicable), in_format, stated_authorised
    and registry_authorised, stated_paid_up and registry_paid_up, export_sales and rpt_sale_goods,
    and comparatives, an array of label, stated (this filing's figure of the year before) and filed.
    ``particulars`` are further points that pass where the text names them; for these an empty text
    gives a null value.
    """
    none = {"small_company": "boolean", "csr_applicable": "boolean", "in_format": "string", "export_sales": "double", "rpt_sale_goods": "double", "comparatives": "array<struct<label:string,stated:double,filed:double>>"}
    none |= {f"{a}_{b}": "double" for a in ("stated", "registry") for b in ("authorised", "paid_up")}
    have = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    # the texts are made once, in a step of their own
    low = docs.select(*keys, *[have(c).cast(kind).alias(c) for c, kind in none.items()], F.lower(F.coalesce("full_text", F.lit(""))).alias("t"))
    low = low.withColumn("words", F.regexp_replace(F.regexp_replace("t", "[^a-z0-9 ]", " "), " +", " "))
    t, words = F.col("t"), F.col("words")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    no_headings = missing(t, AUDIT_HEADINGS)
    caro = r"(?:companies auditor s report order|(?:^|[^a-z0-9])caro(?:[^a-z0-9]|$))"
    has_caro = words.contains("companies auditor s report order") | words.contains("caro ") | words.contains(" caro")
    image = t.rlike(IMAGE)
    listed = lambda names: F.concat(F.lit("Missing fields: "), F.array_join(names, ", "))
    no_ids = missing(t, [("CIN", ["cin", "corporate identity number"]), ("DIN", ["din"]), ("Address", ["address", "registered office"])])
    trail = {n: reduce(Column.__and__, [has_any(t, phrases) for phrases in lists]) for n, lists in AUDIT_TRAIL.items()}
    keyword, figures = F.lit("Missing keywords"), F.lit("No numbers near the keywords")

    def first_with_figure(phrases: list[str]) -> tuple[Column, Column]:
        """Of the phrases the first that the text has, and whether a figure stands near it."""
        tests = [F.when(t.contains(p), near(t, literal(p), r"\d", FIGURE_REACH)) for p in phrases]
        found = F.coalesce(*tests, F.lit(None))
        return yes(F.coalesce(found, F.lit(False))), F.when(found.isNull(), keyword).otherwise(figures)

    def registry(name: str) -> tuple[Column, Column]:
        stated, filed = F.col(f"stated_{name}"), F.col(f"registry_{name}")
        known = stated.isNotNull() & filed.isNotNull()
        return F.when(known, yes(within(stated, filed, REGISTRY_OFF))).otherwise("Missing Data"), F.when(known, "Differs from the registry").otherwise("Missing registry data")

    forex = "(?:" + "|".join(map(literal, FOREX)) + ")"
    compared = F.filter(F.coalesce("comparatives", F.array().cast(none["comparatives"])), lambda x: x["stated"].isNotNull() & x["filed"].isNotNull())
    differ = F.transform(F.filter(compared, lambda x: ~within(x["stated"], x["filed"], YEAR_OFF)), lambda x: x["label"])
    traded = F.col("export_sales").isNotNull() & F.col("rpt_sale_goods").isNotNull() & ((F.col("export_sales") > 0) | (F.col("rpt_sale_goods") > 0))
    found = {
        "audit_headings": (yes(F.size(no_headings) == 0), listed(no_headings)),
        "caro": (F.when(has_caro & near(words, caro, "not applicable", 150), "Not Applicable").otherwise(yes(has_caro)), keyword),
        "statement_format": (yes(F.coalesce(F.lower("in_format").isin("yes", "true"), F.lit(False))), F.lit("Format not detected in the tables")),
        "cin_din_address": (yes(F.size(no_ids) == 0), listed(no_ids)),
        "previous_year_figures": (
            F.when(F.size(compared) > 0, yes(F.size(differ) == 0)).otherwise(yes(t.rlike(PREVIOUS_YEAR))),
            F.when(F.size(differ) > 0, F.concat(F.lit("Do not tally: "), F.array_join(differ, ", "))).otherwise("Missing comparative figures"),
        ),
        "five_percent_holders": (yes(has_any(t, ["5%", "5 percent"]) & has_any(t, ["shareholder", "holding", "promoter"])), keyword),
        "statutory_register": (F.lit("No"), F.lit("Manual check required")),
        "authorised_capital": registry("authorised"),
        "paid_up_capital": registry("paid_up"),
        "eps": (yes(near(t, EPS, r"\d", EPS_REACH)), F.when(t.rlike(EPS), figures).otherwise(keyword)),
        "signed_by_both": (yes(t.contains("director") & has_any(t, ["auditor", "partner", "chartered accountant"]) & image), F.lit("Missing signatures or seal")),
        "udin": (yes(t.rlike(r"(?:^|[^a-z0-9_])(?:udin|\d{18})(?:[^a-z0-9_]|$)")), keyword),
        "auditor_seal": (yes(has_any(t, ["seal", "stamp"]) | image), F.lit("Missing seal")),
        "related_party_sales": (
            F.when(traded, yes(F.col("export_sales") == F.col("rpt_sale_goods"))).otherwise(yes(has_any(t, RELATED))),
            F.when(traded, "Exports differ from sales to related parties").otherwise(keyword),
        ),
        "forex": (yes(near(t, forex, r"\d", FIGURE_REACH)), F.when(t.rlike(forex), figures).otherwise(keyword)),
        "board_resolution": (F.lit("No"), F.lit("Manual check required")),
        "directors_abroad": (F.lit("No"), F.lit("Manual check required")),
    } | {name: (yes(has_any(t, phrases)), keyword) for name, phrases in ANY_PHRASE.items()}
    value, reason = found["cash_flow_statement"]
    small = F.coalesce("small_company", F.lit(False))
    found["cash_flow_statement"] = (F.when(small, "Not Applicable").otherwise(value), F.when(small, "Exempt because it is a Small Company.").otherwise(reason))
    for name, phrases in CSR.items():
        value, reason = first_with_figure(phrases)
        applies = F.coalesce("csr_applicable", F.lit(False))
        found[name] = (F.when(applies, value).otherwise("Not Applicable"), F.when(applies, reason).otherwise("Social responsibility is not applicable"))
    found |= {f"audit_trail_{n}": (yes(c), keyword) for n, c in trail.items()}
    # the verdict is No as soon as any check before it has failed
    found["audit_trail_verdict"] = (yes(reduce(Column.__and__, trail.values())), F.lit("A check of the audit trail failed"))
    for name in particulars:
        key = name.lower().replace("whether audit report has the following fields -", "").strip().replace("details of", "").strip().replace("?", "").strip()
        found[name] = (F.when(t != "", yes(t.contains(key) if key else F.lit(False))), keyword)
    made = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("user_value"), r.alias("why")) for n, (v, r) in found.items()])
    passed = F.coalesce(F.col("c.user_value") == "Yes", F.lit(False))
    out = low.select(*keys, F.explode(made).alias("c"))
    return out.select(*keys, "c.check", "c.user_value", F.when(passed, "Passed").otherwise("Failed").alias("status"), F.when(passed, "").otherwise(F.col("c.why")).alias("reason"))
