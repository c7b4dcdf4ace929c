"""What goes into a return grid: extracted fields, the register's figures, defaults and the previous return.

Each job adds columns to one wide row a filing (filing_id and fields; null or absent stands for not
extracted), so only the joins with the register and the previous return deal rows out, by filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.register import ALL_BUCKETS
from tallyloom.operators.return_grid import LAKH

CLASSES = ("equity", "part_pref", "non_part_pref")
YEARS = ("py", "fy")
#: How many classes of shares a filing has if no register tells.
CLASS_COUNTS = {"equity": 1, "part_pref": 0, "non_part_pref": 0}
#: Fields in money, which the grid holds in lakhs.
MONEY = (
    "profit_before_tax", "profit_after_tax", "dividend_paid", "tax_on_dividend", "reserves_and_surplus", "pl_balance",
    "domestic_sales", "export_sales", "revenue_from_operations", "domestic_purchases", "import_purchases", "total_purchases",
)
#: What a return of the unit is divided by to be in lakhs.
UNITS = {"Actuals": LAKH, "Thousands": 100.0}
#: Fields that come from the previous return even if they are empty there.
ALWAYS = ("contact_name", "telephone", "email_id", "email_contact", "company_type", "website")
#: Fields for which the previous return is the only authority.
AUTHORITY = ("contact_name", "telephone", "mobile_number", "email_id", "email_contact", "designation", "website", "company_type", "pan_number")
FILING_YEAR = 2025


def _get(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def register_row(class_totals: DataFrame) -> DataFrame:
    """One row a filing with count, amount, n_classes and face_value of each class of shares, from rows of filing_id and share_class."""
    return class_totals.groupBy("filing_id").pivot("share_class", list(CLASSES)).agg(*[F.first(c).alias(c) for c in ("count", "amount", "n_classes", "face_value")])


def from_register(fields: DataFrame, register: DataFrame, buckets: DataFrame) -> DataFrame:
    """Fields with the register's figures, which win where it has shares of the class; the previous year's are the same.

    register is register_row's, buckets a row a filing of counts and amounts of non-residents. Amounts
    become lakhs. Amounts of capital always are the register's, 0 without one; numbers of classes
    without one are the usual ones; buckets and face values without one stay as extracted.
    """
    r = register.select("filing_id", *[F.col(c).alias(f"__{c}") for c in register.columns if c != "filing_id"])
    b = buckets.select("filing_id", *[F.col(c).alias(f"__nr_{c}") for c in buckets.columns if c != "filing_id"])
    out = fields.join(r, "filing_id", "left").join(b, "filing_id", "left")
    made = {}
    for c in CLASSES:
        count, amount = _zero(_get(out, f"__{c}_count")), _zero(_get(out, f"__{c}_amount")) / LAKH
        for y in YEARS:
            made[f"{c}_shares_count_{y}"] = F.when(count > 0, count).otherwise(_get(fields, f"{c}_shares_count_{y}"))
            made[f"{c}_shares_amount_{y}"] = F.when(count > 0, amount).otherwise(_get(fields, f"{c}_shares_amount_{y}"))
            made[f"{c}_amount_lakhs_{y}"] = amount
            made[f"{c}_class_count_{y}"] = F.coalesce(_get(out, f"__{c}_n_classes", "long"), F.lit(CLASS_COUNTS[c]).cast("long"))
            made[f"{c}_face_value_{y}"] = F.coalesce(_get(out, f"__{c}_face_value"), _get(fields, f"{c}_face_value_{y}"))
    for n in ALL_BUCKETS:
        count, amount = _get(out, f"__nr_{n}_count"), _get(out, f"__nr_{n}_amount")
        for y in YEARS:
            made[f"nr_shares_{n}_{y}"] = F.coalesce(count, _get(fields, f"nr_shares_{n}_{y}"))
            made[f"nr_amount_{n}_lakhs_{y}"] = F.coalesce(F.when(count.isNotNull(), _zero(amount) / LAKH), _get(fields, f"nr_amount_{n}_lakhs_{y}"))
    kept = [c for c in fields.columns if c not in made]
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])


def with_defaults(fields: DataFrame, defaults: list[tuple[str, object]]) -> DataFrame:
    """Fields that are null or absent take their default; of several defaults of a field the last that is not null."""
    last = {}
    for name, value in defaults:
        last[name] = value if value is not None else last.get(name)
    return fields.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in fields.columns else F.lit(v) for n, v in last.items()})


def status_fields(fields: DataFrame) -> DataFrame:
    """Adds filing_year, listed_status by the first letter of cin_number, closing_date and the market prices of both years (N/A unless listed)."""
    year = F.coalesce(_get(fields, "filing_year", "int"), F.lit(FILING_YEAR))
    cin = F.upper(F.trim(_get(fields, "cin_number", "string")))
    listed = F.when(cin.startswith("L"), "Yes").when(cin.startswith("U"), "No").otherwise(F.coalesce(_get(fields, "listed_status", "string"), F.lit("No")))
    date = F.coalesce(F.nullif(_get(fields, "closing_date", "string"), F.lit("")), F.concat(F.lit("31/03/"), year.cast("string")))
    out = fields.withColumns({"filing_year": year, "listed_status": listed, "closing_date": date})
    price = F.when(F.col("listed_status") == "No", "N/A").otherwise("0.0")
    return out.withColumns({f"listed_market_price_{y}": price for y in YEARS})


def face_capital(fields: DataFrame) -> DataFrame:
    """Adds {class}_face_lakhs_{year}: shares times face value in lakhs, 0 where either is unknown."""
    return fields.withColumns({f"{c}_face_lakhs_{y}": _zero(_get(fields, f"{c}_shares_count_{y}")) * _zero(_get(fields, f"{c}_face_value_{y}")) / LAKH for c in CLASSES for y in YEARS})


def in_lakhs(fields: DataFrame) -> DataFrame:
    """The money fields in lakhs by the unit in financials_scale (Actuals if null, Thousands; anything else is lakhs already)."""
    unit = F.coalesce(_get(fields, "financials_scale", "string"), F.lit("Actuals"))
    by = F.lit(1.0)
    for name, value in UNITS.items():
        by = F.when(unit == name, value).otherwise(by)
    money = [f"{m}_{y}" for m in MONEY for y in YEARS if f"{m}_{y}" in fields.columns]
    return fields.withColumns({m: F.col(m).cast("double") / by for m in money})


def prefill(fields: DataFrame, previous: DataFrame, always: tuple[str, ...] = ALWAYS) -> DataFrame:
    """Empty fields (null or the empty text) take the previous return's value.

    Values that are empty there only replace nulls, and only for the fields named by always. previous
    has filing_id, once each, and text columns of the same names; filings without one stay as they are.
    """
    names = [c for c in previous.columns if c != "filing_id"]
    before = previous.select("filing_id", *[F.col(c).alias(f"__{c}") for c in names])
    made = {}
    for c in names:
        now, then = _get(fields, c, "string"), F.col(f"__{c}").cast("string")
        usable = then.isNotNull() & (F.lit(c in always) | (then != ""))
        made[c] = F.when(usable & (now.isNull() | (now == "")), then).otherwise(now)
    kept = [c for c in fields.columns if c not in made]
    return fields.join(before, "filing_id", "left").select(*kept, *[c.alias(n) for n, c in made.items()])


def overwrite(fields: DataFrame, previous: DataFrame, names: tuple[str, ...] = AUTHORITY) -> DataFrame:
    """The named fields are the previous return's wherever it has them, empty or not."""
    own = [c for c in names if c in previous.columns]
    before = previous.select("filing_id", *[F.col(c).alias(f"__{c}") for c in own])
    kept = [c for c in fields.columns if c not in own]
    return fields.join(before, "filing_id", "left").select(*kept, *[F.coalesce(F.col(f"__{c}").cast("string"), _get(fields, c, "string")).alias(c) for c in own])


def holder_capital(holders: DataFrame, grid: DataFrame, other: bool) -> DataFrame:
    """Adds equity_capital, liabilities (the same) and other_capital of both years to rows of filing_id and equity_percent_py, _fy.

    Capital is the percentage of the year's net worth. other (direct investors): the rest is
    other_liabilities less other_claims, nulls 0; without it (other countries) the rest is 0.
    """
    worth = grid.select("filing_id", F.col("ii_f34").alias("__worth_py"), F.col("ii_g34").alias("__worth_fy"))
    out = holders.join(worth, "filing_id", "left")
    made = {}
    for y in YEARS:
        capital = _zero(_get(out, f"equity_percent_{y}")) / 100 * _zero(F.col(f"__worth_{y}"))
        rest = _zero(_get(out, f"other_liabilities_{y}")) - _zero(_get(out, f"other_claims_{y}")) if other else F.lit(0.0)
        made |= {f"equity_capital_{y}": capital, f"liabilities_{y}": capital, f"other_capital_{y}": rest}
    return out.withColumns(made).drop("__worth_py", "__worth_fy")
