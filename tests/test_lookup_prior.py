"""Names found within other names, and previous returns of odd forms."""

import random

import pytest

from tallyloom import plans
from tallyloom.operators import lookup, prior_return

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("q", [2, 5])
def test_contained_against_all_pairs(spark, q):
    rng = random.Random(q)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(rng.randint(0, n)))
    needles, hay = [word(8) for _ in range(80)] + ["", "a"], [word(25) for _ in range(120)] + ["", "a"]
    one, two = (spark.createDataFrame([(t,) for t in [*texts, None]], "text string") for texts in (needles, hay))
    got = [(r.needle, r.hay) for r in lookup.contained(one, two, q).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, h) for n in needles for h in hay if n in h}


@pytest.mark.parametrize("name", ["j10_field_lookup", "j16_cascade_match", "j18_official_fields"])
def test_no_text_meets_all_others(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def found(spark, keys, fields):
    parsed = spark.createDataFrame([(1, i, k, f"v{i}") for i, k in enumerate(keys)], "filing_id long, ord long, key string, value string")
    return {r.field: (r.value, r.tier) for r in lookup.lookup(parsed, spark.createDataFrame([(f,) for f in fields], "field string")).collect()}


def test_tiers_flags_and_generic_keys(spark):
    fields = ["Net worth", "Net worth__shares", "Total paid-up capital", "Tax", "Mobile Number", "Total Equity & Participating Preference share capital"]
    assert found(spark, ["total", "NET worth", "Net worth"], fields)["Net worth"] == ("v2", 1)
    assert found(spark, ["total", "NET worth", "networth"], fields)["Net worth"] == ("v1", 2)
    got = found(spark, ["shares", "my net worth__PY", "my net worth__shares", "5 total paidup capital x", "taxes", "mobile", "total equity participating only"], fields)
    assert got == {"Net worth__shares": ("v2", 4), "Total paid-up capital": ("v3", 3), "Mobile Number": ("v5", 4), "Total Equity & Participating Preference share capital": ("v6", 3)}
    assert found(spark, ["***"], fields)["Net worth"] == ("v0", 4)
    assert found(spark, [], fields) == {} and found(spark, ["x y z"], []) == {}


def fields_of(spark, text):
    return {r.key: r.value for r in prior_return.prior_fields(spark.createDataFrame([(1, text)], "filing_id long, text string")).collect()}


def test_previous_returns_of_odd_forms(spark):
    assert fields_of(spark, None) == {} == fields_of(spark, "") == fields_of(spark, "nothing here\n| a |")
    assert fields_of(spark, "**Key** : a\n**Key** : b\n2.b Other key : c : d") == {"Key": "b", "2.b Other key": "c : d"}
    # no year: the default ones; a year in the third row; a single column for each year; short rows
    text = "| Type | A | B |\n|---|---|---|\n| x |\n| | in 2020 | in 2019 |\n| Equity | 5 | 6 |\n| Equity | 7 | 8 |\n| Only | | 9 |\n"
    assert fields_of(spark, text) == {"Equity": "5", "Equity__PY": "6", "Only__PY": "9"}
    assert fields_of(spark, "| Item | 2025 | 2024 |\n|---|---|---|\n| A | 1 | 2 |") == {"A": "1", "A__PY": "2"}
    assert fields_of(spark, "| Item | One | Two |\n|---|---|---|\n| A | 1 | 2 |") == {}
    three = "| Item | 2022 | 2022 | 2022 | 2021 |\n|---|---|---|---|---|\n| A | 1 | 2 | 3 | 4 |"
    assert fields_of(spark, three) == {"A": "1", "A__PY": "4"}
    named = fields_of(spark, "**Email of Contact Person** : a@b\n**E-Mail of Contact person** : c@d\n**Mobile no** : 5")
    assert named["E-Mail of Contact person"] == "c@d" and named["Mobile Number"] == "5" and named["Mobile Number*"] == "5"


def test_a_template_against_nothing(spark):
    template = spark.createDataFrame([("Section I", 0, 1, "Field name"), ("Section I", 0, 2, "Source"), ("Section I", 1, 1, "Name"), ("Section I", 1, 2, "prefill unless changed")], "sheet string, row_no int, col_no int, value string")
    prior = spark.createDataFrame([], "filing_id long, ord long, key string, value string")
    grid = spark.createDataFrame([(7, "Section I", 1, 2, "")], "filing_id long, sheet string, row_no int, col_no int, value string")
    got = prior_return.against_template(template, prior, grid).collect()
    assert [(r.filing_id, r.field, r.final, r.reason) for r in got] == [(7, "Name", "", "Both Missing -> Left Blank")]
    assert prior_return.against_template(template, prior, grid.limit(0)).count() == 0
