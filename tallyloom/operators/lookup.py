"""Names that people write, found again under names that others wrote: an index of character grams yields what may contain what.

A text that lies within another shares all its grams with it. So of each sought text only the gram
that the fewest others have is looked up, and what it finds is confirmed; no text meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import clean_key
from tallyloom.sources.shared import dealt, saved

#: Cleaned keys that say too little to be a field.
GENERIC = ("total", "name", "value", "shares", "class")
#: Fields (cleaned) that are found by other words, and these.
OVERRIDES = [
    ("total paidup capital", ["total paidup capital"]),
    ("total equity participating preference share capital", ["total equity and participating", "total equity participating"]),
]
#: Parts of a field's name that its keys need not have, and the words of a previous year.
IDLE_TOKENS = ("and", "of", "the", "amount", "lakhs", "count", "share", "shares")
PREVIOUS = ("py", "previous", "2024", "prior")
#: What stands for no value.
NO_VALUE = ("", "Unknown", "N/A")


def grams(text: Column, q: int) -> Column:
    """The distinct substrings of q characters."""
    return F.when(F.length(text) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q)))).otherwise(F.array().cast("array<string>"))


def contained(sought: DataFrame, texts: DataFrame, q: int) -> DataFrame:
    """needle and hay: each distinct text of sought with each distinct text that contains it. Both have one column, text.

    Sought texts of fewer than q characters are looked up as they are among all short substrings; the
    others by the gram that the fewest texts have. A gram that no text has ends the search.
    """
    hay = texts.select(F.col("text").alias("hay")).filter("hay is not null").distinct()
    needle = sought.select(F.col("text").alias("needle")).filter("needle is not null").distinct()
    parted = saved(needle.select("needle", F.explode(grams(F.col("needle"), q)).alias("gram")), "grams")
    asked = saved(parted.select("gram").distinct(), "asked")
    # only grams that are asked for are dealt out
    index = hay.select("hay", F.explode(grams(F.col("hay"), q)).alias("gram")).join(asked, "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = parted.join(dealt(often), "gram", "left")
    rarest = own.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0").select("needle", "r.gram")
    long = rarest.join(dealt(index), "gram").filter(F.col("hay").contains(F.col("needle"))).select("needle", "hay")
    short = needle.filter(F.length("needle") < q)
    parts = hay.select("hay", F.explode(F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *(grams(F.col("hay"), k) for k in range(1, q)))))).alias("needle"))
    return long.union(short.join(dealt(parts), "needle").select("needle", "hay"))


def _flags(c: str) -> list[Column]:
    return [F.col(c).contains("__shares"), F.col(c).contains("__PY")]


def field_pairs(keys: DataFrame, fields: DataFrame) -> DataFrame:
    """key, field and tier for keys (one column, key) that may stand for fields (one column, field).

    1 equal; 2 equal when cleaned; 3 by the words of OVERRIDES; 4 one cleaned text within the other,
    for fields of 5 characters or more and keys that are not GENERIC, or both of a mobile number. In
    tiers 3 and 4 both or neither are of shares, and of the previous year.
    """
    k = saved(keys.select("key").distinct(), "keys").withColumn("ck", clean_key(F.col("key")))
    f = fields.select("field").distinct().withColumn("cf", clean_key(F.col("field")))
    for df, c in ((k, "key"), (f, "field")):
        shares, py = _flags(c)
        made = df.withColumns({f"{c}_shares": shares, f"{c}_py": py})
        k, f = (made, f) if c == "key" else (k, made)
    alike = (F.col("key_shares") == F.col("field_shares")) & (F.col("key_py") == F.col("field_py"))
    equal = k.join(f, F.col("key") == F.col("field")).select("key", "field", F.lit(1).alias("tier"))
    cleaned = k.join(f, F.col("ck") == F.col("cf")).select("key", "field", F.lit(2).alias("tier"))

    def number(c: str, words: int) -> Column:
        """Which override a text is of."""
        out = F.lit(None).cast("int")
        for i, (field, others) in enumerate(OVERRIDES):
            test = F.col(c) == field
            if words:
                test = F.lit(False)
                for w in others:
                    test = test | F.col(c).contains(w)
            out = F.when(test, i).otherwise(out)
        return out

    by_words = k.withColumn("no", number("ck", 1)).filter("no is not null").join(f.withColumn("of", number("cf", 0)).filter("of is not null"), (F.col("no") == F.col("of")) & alike).select("key", "field", F.lit(3).alias("tier"))

    some_k, some_f = k.filter(~F.col("ck").isin(*GENERIC)), f.filter(F.length("cf") >= 5)
    texts = lambda df, c: df.select(F.col(c).alias("text"))
    in_key = contained(texts(some_f, "cf"), texts(some_k, "ck"), 5).toDF("cf", "ck")
    in_field = contained(texts(some_k, "ck"), texts(some_f, "cf"), 5).toDF("ck", "cf").select("cf", "ck")
    within = in_key.union(in_field).distinct().join(dealt(some_k), "ck").join(some_f, "cf").filter(alike).select("key", "field", F.lit(4).alias("tier"))
    mobile = lambda df, c: df.filter(F.col(c).contains("mobile")).withColumn(f"mobile_{c}", F.lit(1))
    phones = mobile(some_k, "ck").join(mobile(some_f, "cf"), (F.col("mobile_ck") == F.col("mobile_cf")) & alike).select("key", "field", F.lit(4).alias("tier"))
    return equal.union(cleaned).union(by_words).union(within).union(phones).groupBy("key", "field").agg(F.min("tier").alias("tier"))


def lookup(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    """filing_id, field, value, key and tier: what each filing's keys say of each field, for fields that any key fits.

    parsed: filing_id, ord (the key's place), key and value. The least tier counts, and within it the
    first key. Only distinct keys, which are written first, are compared
    with fields; a hot filing costs no more than its rows.
    """
    pairs = field_pairs(parsed, fields)
    met = parsed.select("filing_id", "ord", "key", "value").join(dealt(pairs), "key")
    best = met.groupBy("filing_id", "field").agg(F.min_by(F.struct("value", "key", "tier"), F.struct("tier", "ord", "key")).alias("b"))
    return best.select("filing_id", "field", "b.value", "b.key", "b.tier")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def normalise_payload(payload: DataFrame, aliases: DataFrame, fields: DataFrame) -> DataFrame:
    """filing_id, field, value and way for each official field that a filing's payload gives a value.

    payload: filing_id, ord, key, value. aliases: field and words (an array). fields: field, of the
    form ``name_parts_py``. A field that the payload has by name with a value keeps it (way own).
    Else the first key that contains one of the field's aliases counts (alias), else the first that
    contains all telling parts of its name (parts); of a ``_py`` field the key must speak of the
    previous year, of an ``_fy`` field it must not. Keys count as letters and digits only, those
    without a value not at all; of keys that are equal so, the first place and the last value count.
    """
    sound = ~F.coalesce("value", F.lit("")).isin(*NO_VALUE)
    own = payload.filter(sound).select("filing_id", F.col("key").alias("field"), "ord", "value")
    names = fields.select("field").union(aliases.select("field")).distinct()
    kept = own.join(names, "field").groupBy("filing_id", "field").agg(F.max_by("value", "ord").alias("value")).withColumn("way", F.lit("own"))
    keys = payload.filter(sound).withColumn("plain", _plain(F.col("key"))).groupBy("filing_id", "plain").agg(F.min("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    keys = saved(keys, "payload")
    texts = keys.select(F.col("plain").alias("text")).distinct()

    words = aliases.select("field", F.explode("words").alias("word"))
    by_alias = contained(words.select(F.col("word").alias("text")), texts, 3).toDF("word", "plain").join(words, "word").select("field", "plain").distinct().withColumn("nth", F.lit(1))

    year = F.regexp_extract("field", "_(py|fy)$", 1)
    parts = F.filter(F.split(F.regexp_replace("field", "_(py|fy)$", ""), "_"), lambda t: ~t.isin(*IDLE_TOKENS))
    told = fields.select("field", year.alias("year"), parts.alias("parts")).filter(F.size("parts") > 0)
    told = told.withColumn("longest", F.array_max(F.transform("parts", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    may = contained(told.select(F.col("longest").alias("text")), texts, 3).toDF("longest", "plain").join(told, "longest")
    previous = F.lit(False)
    for w in PREVIOUS:
        previous = previous | F.col("plain").contains(w)
    right_year = F.when(F.col("year") == "py", previous).when(F.col("year") == "fy", ~previous).otherwise(True)
    by_parts = may.filter(right_year & F.forall("parts", lambda t: F.col("plain").contains(t))).select("field", "plain").distinct().withColumn("nth", F.lit(2))

    met = keys.join(dealt(by_alias.union(by_parts)), "plain").groupBy("filing_id", "field").agg(F.min_by(F.struct("value", "nth"), F.struct("nth", "ord")).alias("b"))
    found = met.join(dealt(kept.select("filing_id", "field")), ["filing_id", "field"], "left_anti")
    return kept.unionByName(found.select("filing_id", "field", "b.value", F.when(F.col("b.nth") == 1, "alias").otherwise("parts").alias("way")))


