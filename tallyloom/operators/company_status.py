"""What a filing's running text says of the company's standing: its group, and the standards it reports by. Projections only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of a group's head, of a member, and of weaker signs, which count 20 each towards 100.
HOLDING = ("holding company", "parent company:", "subsidiaries:", "list of subsidiaries")
SUBSIDIARY = ("subsidiary company", "is a subsidiary", "the company is a wholly owned subsidiary")
SIGNS = ("investment in subsidiaries", "investment in associates", "consolidated financial statements comprise", "consolidated financial statements", "schedule of subsidiaries")
SIGN_WEIGHT, SIGNS_NEEDED = 20, 100
#: The share of a company that is named near these words.
OWNED = r"(?:ownership|holding|subsidiary|investment).{0,50}?(\d{2,3}(?:\.\d+)?)\s*%"
#: The first rows of a balance sheet, by standard, and words of the standard.
ASSETS = r"\|\s*(?:[ivx\d\.\-\(\)]*\s*)?assets\s*\|"
LIABILITIES = r"\|\s*(?:[ivx\d\.\-\(\)]*\s*)?(?:equity and liabilities|liabilities and equity|equity & liabilities)\s*\|"
STANDARD = r"\b(?:indian accounting standard|ind as|companies \(indian accounting standards\) rules|ind-as)\b"


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def group_status(text: Column) -> Column:
    """holding, subsidiary or no.

    Phrases of a head count before those of a member; then a share of more than 50 and at most 100
    percent makes a head; then weaker signs, if they add up. A null text says no.
    """
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    shares = F.regexp_extract_all(low, F.lit(OWNED), 1)
    owned = F.exists(shares, lambda s: (s.cast("double") > 50) & (s.cast("double") <= 100))
    score = sum((F.when(low.contains(w), SIGN_WEIGHT).otherwise(0) for w in SIGNS), F.lit(0))
    return F.when(_says(low, HOLDING), "holding").when(_says(low, SUBSIDIARY), "subsidiary").when(owned | (score >= SIGNS_NEEDED), "holding").otherwise("no")


def standard_applies(text: Column) -> Column:
    """yes or no: do assets stand before liabilities in the balance sheet? Where not both have a row, do the standard's words occur? A null text says no."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(low, r"[*_]|<b>|</b>|<br>", "")
    assets, liabilities = F.regexp_instr(plain, F.lit(ASSETS)), F.regexp_instr(plain, F.lit(LIABILITIES))
    by_rows = F.when((assets > 0) & (liabilities > 0), F.when(assets < liabilities, "yes").otherwise("no"))
    return F.coalesce(by_rows, F.when(F.regexp_replace(low, r"\s+", " ").rlike(STANDARD), "yes").otherwise("no"))


def corporate_shareholder(category: Column, name: Column) -> Column:
    """Is a holder a company, by its category or its name?"""
    text = F.lower(F.concat_ws(" ", category, name))
    return text.rlike(r"\b(body corporate|bodies corporate|company|corporate|ltd|limited|llp|inc)\b")
