"""The amounts and labels that filings write, one by one."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import cleaning


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (cleaning.statement_number, "1,234.50", 1234.5), (cleaning.statement_number, "(12.00)", -12.0), (cleaning.statement_number, "-", 0.0), (cleaning.statement_number, "", 0.0), (cleaning.statement_number, None, 0.0),
        (cleaning.statement_number, "1,234,50", 1234.5), (cleaning.statement_number, "5<br>6", 5.0), (cleaning.statement_number, "n/a", 0.0),
        (cleaning.workbook_number, "", None), (cleaning.workbook_number, "-", 0.0), (cleaning.workbook_number, "(7)", -7.0), (cleaning.workbook_number, "abc", None),
        (cleaning.rule_number, "(7)", 7.0), (cleaning.rule_number, "Rs 1,000", 1000.0), (cleaning.rule_number, "x", None),
        (cleaning.overseas_number, "1,000", 1000.0), (cleaning.overseas_number, "x", 0.0),
        (cleaning.yes_no, " Y ", "yes"), (cleaning.yes_no, "0", "no"), (cleaning.yes_no, "N/A", "not applicable"), (cleaning.yes_no, "maybe", None),
        (cleaning.null_text, "NaN", ""), (cleaning.null_text, " a ", "a"), (cleaning.placeholder_to_blank, "Enter name", ""),
        (cleaning.clean_key, "Net_Worth  (PY)", "networth py"), (cleaning.strip_markup, "<b>**Total**</b>  x", "Total x"),
        (cleaning.scale_multiplier, "Rs in thousands, some in lakhs", 1e5), (cleaning.scale_multiplier, "(in '000)", 1e3), (cleaning.scale_multiplier, "rupees", 1.0),
        (cleaning.looks_numeric, "1,2.-", True), (cleaning.looks_numeric, "-", False),
        (cleaning.outline_level, "IV. x", 0), (cleaning.outline_level, "3. x", 1), (cleaning.outline_level, "(i) x", 2), (cleaning.outline_level, "(ii) x", 3),
    ],
)
def test_values(spark, f, text, want):
    assert value(spark, f, text) == want
