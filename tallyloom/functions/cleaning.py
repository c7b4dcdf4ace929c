"""Column functions that clean labels and amounts as filings write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_markup(c: Column) -> Column:
    """Tags become spaces, **bold** its text, and runs of spaces one."""
    plain = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\*\*(.+?)\*\*", "$1")
    # most texts have none of these, and need no pattern
    return F.when(c.contains("<") | c.contains("**") | c.contains("  "), F.trim(F.regexp_replace(plain, " {2,}", " "))).otherwise(F.trim(c))


def statement_number(c: Column) -> Column:
    """An amount of a statement: first line of the cell, dashes and blanks 0, parentheses negative, a final comma before two digits is a decimal point; else 0."""
    first = F.trim(F.regexp_replace(F.split(F.regexp_replace(c, "(?i)<br ?/?>", "\n"), "\n").getItem(0), "<[^>]+>", ""))
    negative = first.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.regexp_replace(first, r",(\d\d)$", ".$1"), "[^0-9.-]", "")
    value = F.coalesce(bare.try_cast("double"), F.lit(0.0))
    return F.when(first.isNull() | first.isin("", "-", "—"), 0.0).otherwise(F.when(negative, -F.abs(value)).otherwise(value))


def workbook_number(c: Column) -> Column:
    """An amount of a workbook cell: blank is null, a dash 0, parentheses negative; else null."""
    t = F.trim(c)
    value = F.regexp_replace(t, "[^0-9.-]", "").try_cast("double")
    return F.when(t.isNull() | (t == ""), None).when(t == "-", 0.0).when(t.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)


def rule_number(c: Column) -> Column:
    """An amount as the rules read it: digits, points and minus signs; parentheses are not negative."""
    return F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")


def overseas_number(c: Column) -> Column:
    """An amount of an overseas sheet: commas go, anything else that is no number is 0."""
    return F.coalesce(F.replace(c, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def looks_numeric(c: Column) -> Column:
    return F.translate(c, ",. -", "").rlike("^[0-9]+$")


def yes_no(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("yes", "y", "true", "1"), "yes").when(t.isin("no", "n", "false", "0"), "no").when(t.isin("na", "n/a", "not applicable"), "not applicable")


def null_text(c: Column) -> Column:
    """The words that stand for nothing become the empty text."""
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("nan", "nat", "none", "null", ""), "").otherwise(F.trim(c))


def placeholder_to_blank(c: Column) -> Column:
    return F.when((F.trim(c) == "0") | F.lower(c).rlike("enter |mention |provide |dropdown"), "").otherwise(c)


def clean_key(c: Column) -> Column:
    """Lower case letters, digits and single spaces; underscores vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def squash_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def field_slug(c: Column) -> Column:
    return F.concat(F.lit("field_"), F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), 1, 50))


#: Scale words in the order in which they are looked for, and what one unit is worth.
SCALES = [("lakhs", "in lakhs?", 1e5), ("thousands", "in thousands?", 1e3), ("millions", "in millions?", 1e6), ("thousands", "in ['’]?000", 1e3), ("crores", "in crores?", 1e7), ("hundreds", "in hundreds?|in (indian )?rupees hundreds?", 1e2)]


def scale_multiplier(text: Column) -> Column:
    """What one unit of the amounts is worth: the first scale in the fixed order that the text names, else 1."""
    return lower_scale(F.lower(text))


def lower_scale(text: Column) -> Column:
    """scale_multiplier of a text in lower case."""
    out = F.lit(None).cast("double")
    for _, pattern, value in reversed(SCALES):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def is_real_number(c: Column) -> Column:
    """A number that is not just a note reference, a whole number from 1 to 50."""
    return c.isNotNull() & ~((c == F.floor(c)) & F.abs(c).between(1, 50))


def outline_level(label: Column) -> Column:
    """0 for capital roman numerals, 1 for digits, 2 for (a), 3 for (ii); one-letter romans in parentheses are letters."""
    t = F.trim(label)
    return F.when(t.rlike(r"^[IVX]+\.?(\s|$)"), 0).when(t.rlike(r"^\d+\.?(\s|$)"), 1).when(t.rlike(r"^\([a-z]\)"), 2).when(t.rlike(r"^\([ivx]+\)"), 3)
