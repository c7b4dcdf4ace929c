"""Rule packs: a wide row of metrics for each filing becomes one flag for each rule.

Every pack is one projection, an array of flags built from Column expressions, and one explode, so
nothing is shuffled however many filings there are. Missing columns of a pack count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRORE = 10_000_000.0
LAKH = 100_000.0


def _number(df: DataFrame, name: str) -> Column:
    """A metric as a double: digits, points and minus signs of a text; null if it is absent or none."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    if dict(df.dtypes)[name] == "string":
        return F.regexp_replace(name, "[^0-9.-]", "").try_cast("double")
    return F.col(name).cast("double")


def _text(df: DataFrame, name: str, default: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(default))) if name in df.columns else F.lit(default)


def _yes(df: DataFrame, name: str) -> Column:
    return _text(df, name, "no") == "yes"


def _flags(df: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column, Column]], source: str) -> DataFrame:
    made = [F.struct(F.lit(i).alias("rule_id"), status.alias("status"), value.alias("user_value"), actual.cast("double").alias("actual_value")) for i, status, value, actual in rules]
    return df.select(*keys, F.explode(F.array(*made)).alias("f")).select(*keys, "f.*", F.lit(source).alias("source"))


def threshold_flags(metrics: DataFrame, keys: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """The 25 threshold rules. A rule that applies is Failed, one that does not is Passed; nulls count as 0."""
    n = lambda name: F.coalesce(_number(metrics, name), F.lit(0.0))
    kind = _text(metrics, "company_type", "private limited company")
    private, public = kind.contains("private"), kind.contains("public")
    listed, ind_as = _yes(metrics, "is_listed"), _yes(metrics, "is_ind_as")
    turnover, puc, reserves, borrowings = n("turnover"), n("paid_up_capital"), n("reserves_and_surplus"), n("borrowings")
    profit, stated = n("net_profit_before_tax"), n("net_worth")
    worth = F.when(stated == 0, puc + reserves).otherwise(stated)
    group = _text(metrics, "is_subsidiary_or_holding", "no")
    registry = F.trim(_text(metrics, "mca_small_company", ""))
    small = F.when(registry.isin("yes", "no"), registry == "yes").otherwise((turnover < 100 * CRORE) & (puc < 10 * CRORE) & ~group.isin("holding", "subsidiary", "yes"))
    light = (puc + reserves <= CRORE) & (borrowings <= CRORE) & (turnover <= 10 * CRORE)
    caro = F.when(private & ~small, ~light).otherwise(~(small | kind.contains("one person")))
    related = n("rpt_sale_goods") + n("rpt_purchase_goods") + n("rpt_monthly_remun") > 0
    corporate = F.lower(F.col("has_corporate_shareholders")) if "has_corporate_shareholders" in metrics.columns else F.lit(None).cast("string")
    applies = {
        "COMP_CARO": caro,
        "COMP_CSR": (worth >= 500 * CRORE) | (turnover >= 1000 * CRORE) | (profit >= 5 * CRORE),
        "COMP_ROTATION": listed | public | (private & (puc >= 50 * CRORE)),
        "COMP_XBRL": listed | ind_as | (puc >= 5 * CRORE) | (turnover >= 100 * CRORE),
        "COMP_VIGIL": borrowings > 50 * CRORE,
        "COMP_IFC": ~private | (turnover >= 50 * CRORE) | (borrowings >= 25 * CRORE),
        "COMP_INT_AUDIT": (turnover >= 200 * CRORE) | (borrowings >= 100 * CRORE),
        "COMP_IND_AS": ind_as | listed | (worth >= 250 * CRORE),
        "COMP_MGT_8": listed | (puc >= 10 * CRORE) | (turnover >= 50 * CRORE),
        "COMP_MGT_7_CERT": ~small,
        "COMP_SEC_AUDIT": listed | (borrowings >= 100 * CRORE) | (public & ((puc >= 50 * CRORE) | (turnover >= 250 * CRORE))),
        "COMP_KMP": listed | (puc >= 10 * CRORE),
        "COMP_LOAN_186": _yes(metrics, "has_loans_investments_guarantees") | (n("loan_given_by_company") > 0) | (n("investments_made") > 0) | (n("total_loans_investments_given") > 0),
        "COMP_LOAN_DIRECTOR": n("loan_to_directors_assets") > 0,
        "COMP_COST_AUDIT": F.lit(False),
        "COMP_CHARGE_FORM": n("secured_loan") > 0,
        "COMP_AOC_1": _yes(metrics, "is_holding_company") | (group == "holding"),
        "COMP_AOC_2": related,
        "COMP_RPT_OMNIBUS": related,
        "COMP_CSR_COMMITTEE": profit * 3 * 0.02 > 50 * LAKH,
        "COMP_DEPOSIT_DEC": n("loan_from_directors") > 0,
        "COMP_DPT_3": borrowings + n("advance_from_customers") > 0,
        "COMP_MSME": n("dues_to_msme") > 0,
    }
    failed = lambda c: F.when(c, "Failed").otherwise("Passed")
    none = F.lit(None).cast("double")
    rules = [("COMP_SMALL_CO", F.when(small, "Passed").otherwise("Failed"), F.when(small, "Yes").otherwise("No"), none)]
    rules += [(i, failed(c), F.when(c, "Applicable").otherwise("Not Applicable"), none) for i, c in applies.items()]
    held = corporate == "yes"
    rules.append(("COMP_BEN_2", F.when(corporate.isNull(), "Manual").otherwise(failed(held)), F.when(corporate.isNull(), "Missing Data").when(held, "Applicable").otherwise("Not Applicable"), none))
    return _flags(metrics, list(keys), rules, "threshold")


def loan_flags(metrics: DataFrame, keys: tuple[str, ...] = ("filing_id",), strict_compat: bool = False) -> DataFrame:
    """The 18 rules on related parties and loans. A limit whose base is null or 0 is Manual.

    strict_compat: pay for an office of profit is never found, as where its name is misread.
    """
    n = lambda name: _number(metrics, name)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda base, part: F.when(n(base) != 0, n(base) * part)
    of_turnover, of_worth = share("prev_turnover", 0.10), share("prev_net_worth", 0.10)
    limits = [
        ("rpt_sale_goods", of_turnover), ("rpt_purchase_goods", of_turnover),
        ("rpt_sale_property", of_worth), ("rpt_purchase_property", of_worth), ("rpt_dispose_property", of_worth),
        ("rpt_availing_service", of_turnover), ("rpt_rendering_service", of_turnover), ("rpt_lease", of_turnover),
        ("" if strict_compat else "rpt_monthly_remun", F.lit(250_000.0)), ("rpt_remuneration_underwriting", share("prev_net_worth", 0.01)),
    ]
    rules = []
    for i, (name, limit) in enumerate(limits):
        actual = zero(n(name))
        rules.append((f"COMP_SEC_188_{i}", F.when(limit.isNull(), "Manual").when(actual >= limit, "Failed").otherwise("Passed"), F.when(limit.isNull(), "Missing Data").when(actual >= limit, "Yes").otherwise("No"), actual))
    puc, borrowings, given = n("paid_up_capital"), n("borrowings"), zero(n("total_loans_investments_given"))
    free = zero(n("free_reserves") if "free_reserves" in metrics.columns else n("reserves_and_surplus")) + zero(n("securities_premium"))
    passed, none = F.lit("Passed"), F.lit(None).cast("double")
    yes_no = lambda c: F.when(c, "Yes").otherwise("No")
    first = 0.60 * (puc + free)
    below = F.coalesce(borrowings < F.least(2 * puc, F.lit(50 * CRORE)), F.lit(False)) & F.coalesce(puc != 0, F.lit(False))
    director = _yes(metrics, "has_loans_to_directors")
    rules += [
        ("COMP_SEC_186_LOANS", passed, yes_no(given > 0), given),
        ("COMP_SEC_186_SEC", passed, F.lit("No"), F.lit(0.0)),
        ("COMP_SEC_186_L1", F.when(puc.isNull(), "Manual").otherwise("Passed"), F.lit("Applicable"), first),
        ("COMP_SEC_186_L2", passed, F.lit("Applicable"), free),
        ("COMP_SEC_185_BASE", F.when(director, "Failed").otherwise("Passed"), yes_no(director), none),
        ("COMP_SEC_185_EXC1", passed, yes_no(~_yes(metrics, "body_corporate_investors")), none),
        ("COMP_SEC_185_EXC2", passed, yes_no(below), zero(borrowings)),
        ("COMP_SEC_185_EXC3", passed, yes_no(~_yes(metrics, "borrowing_defaults")), none),
    ]
    return _flags(metrics, list(keys), rules, "loans")
