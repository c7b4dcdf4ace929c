"""Line dedup by winnowing over line hashes.

Lines are normalised (lower case, white space as single spaces) and hashed; blank ones do not count.
A window is a run of ``lines`` lines, or one line of at least ``words`` words. The least line hash of
a window is its fingerprint, so any two equal windows share one at the same place. Fingerprints that
occur at several places are joined with the windows around them; each such window is compared as a
whole with all its equals, and those that are not the earliest are marked. Marked windows that
overlap or touch are a match extended both ways, as long as it runs, and all its lines go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch

LINES, WORDS = 2, 20


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " ")))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for each row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(docs: DataFrame, lines: int, words: int) -> DataFrame:
    """doc_id, of (a hash of the text), windows: least (hash and place of the least line), whole (hash of all) and covers (the lines' numbers)."""
    line = lambda x, i: _once(_normal(x), lambda v: F.struct(F.md5(v).alias("hash"), i.alias("at"), (F.size(F.split(v, " ")) >= words).alias("long")))
    filled = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x["hash"] != F.md5(F.lit("")))

    def window(w: Column, no: Column) -> Column:
        whole = F.md5(F.concat(F.array_join(F.transform(w, lambda x: x["hash"]), ""), F.size(w).cast("string")))
        return F.struct(no.alias("no"), F.array_min(F.transform(w, lambda x: F.struct(x["hash"], x["at"]))).alias("least"), whole.alias("whole"), F.transform(w, lambda x: x["at"]).alias("covers"))

    def windows(f: Column) -> Column:
        wide = F.least(F.size(f), F.lit(lines))  # a text of fewer lines is one window
        runs = F.transform(F.sequence(F.lit(1), F.size(f) - wide + 1), lambda i: window(F.slice(f, i, wide), i))
        alone = F.filter(F.transform(f, lambda x, i: F.when(x["long"] & (wide > 1), window(F.array(x), i + 1))), lambda x: x.isNotNull())
        return F.when(F.size(f) > 0, F.concat(runs, alone))

    made = docs.select("doc_id", F.xxhash64("text").alias("of"), _once(filled, windows).alias("windows"))
    return made.filter("windows is not null")


def repeated_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """doc_id, of and gone: the numbers (from 0) of the lines that go, for each document that loses any."""
    scratch = Scratch(docs.sparkSession, "lines")
    windows = scratch.save(_windows(docs, lines, words), "windows")
    # winnowing: one fingerprint for each least line, however many windows of a text it is the least of
    # places as texts, since distinct structs would be sought by comparing all with all
    place_of = lambda w: F.concat(w["least"]["hash"], w["least"]["at"].cast("string"))
    least = windows.select(F.explode(F.array_distinct(F.transform("windows", place_of))).alias("least"))
    prints = least.groupBy(F.substring("least", 1, 32).alias("hash")).count().filter("count > 1").select("hash")
    each = windows.select("doc_id", "of", F.explode("windows").alias("w")).select("doc_id", "of", "w.no", "w.whole", "w.covers", F.col("w.least.hash").alias("hash"))
    near = scratch.save(each.join(prints, "hash", "left_semi").drop("hash"), "near")
    place = F.struct("doc_id", "of", "no")
    first = near.groupBy("whole").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("whole", "first")
    later = near.join(first, "whole").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("covers")))).alias("gone"))


def dedup_lines(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """All columns of docs with text replaced by what stays, and gone, the numbers (from 0) of the lines that went.

    A line goes if it lies in a run of at least ``lines`` non-blank lines that also stands earlier, or
    has at least ``words`` words and stands earlier: in a smaller doc_id, or before it in the same
    text. A text of fewer lines otherwise only matches one that is the same as a whole. Blank lines
    stay, unless nothing else does: then the text is empty. Null and empty texts stay as they are.
    Null ids come first; of rows of equal doc_id the one of the smaller hash of the text is the
    earlier, and rows equal in both count as one. An empty table gives an empty result. Where docs
    has a column gone, it is replaced; other columns may have any name.
    """
    found = repeated_lines(docs.select("doc_id", "text"), lines, words)
    kept = [docs[c] for c in docs.columns if c not in ("text", "gone")]
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["of"]), "left")
    stay = lambda rows: F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), found["gone"])
    left = _once(F.split(docs["text"], "\n"), lambda rows: F.array_join(F.transform(stay(rows), lambda i: F.get(rows, i)), "\n"))
    blank = r"\A[ \t\x0B\f\r\n]*\z"
    text = F.when(found["gone"].isNull(), docs["text"]).otherwise(_once(left, lambda t: F.when(t.rlike(blank), F.lit("")).otherwise(t)))
    out = joined.select(*kept, text.alias("text"), F.coalesce(found["gone"], F.array().cast("array<int>")).alias("gone"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "gone"], "gone")
