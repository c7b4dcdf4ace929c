"""Keyword evidence in lines: first hits by priority, windows before and after, and the heading in force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once


def keyword_hits(lines: DataFrame, words: dict[str, list[str]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, field, priority, line_no: the first line for the best priority (the place in the field's list of patterns).

    One pass over the lines tests all patterns; only hits are grouped, and each task keeps the best
    of its own before anything is dealt out.
    """
    tests = [F.when(F.lower("line").rlike(p), F.struct(F.lit(f).alias("field"), F.lit(i).alias("priority"))) for f, patterns in words.items() for i, p in enumerate(patterns)]
    hits = lines.select(*keys, "line_no", F.explode(F.array_compact(F.array(*tests))).alias("h")).select(*keys, "line_no", "h.*")
    return hits.groupBy(*keys, "field").agg(F.min(F.struct("priority", "line_no")).alias("best")).select(*keys, "field", "best.*")


Test = Callable[[Column], Column]


def _lines(text: str) -> Column:
    return F.split(text, "\r?\n")


def _window(flags: Column, first: Column, last: Column) -> Column:
    """The values from place first to place last (from 0), as far as there are any."""
    start = F.greatest(first, F.lit(0))
    return F.slice(flags, start + 1, F.greatest(F.least(last, F.size(flags) - 1) - start + 1, F.lit(0)))


def supported(docs: DataFrame, hit: Test, support: Test, before: int = 200, after: int = 29, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), line and supported for the lines that hit: does a supporting line stand at most so many lines before or after?

    Lines are looked at in the row of their text; only those that hit leave it.
    """
    near = lambda flags, i: F.exists(_window(flags, i - before, i + after), lambda x: x)
    rows = lambda lines: once(F.transform(lines, lambda x: F.coalesce(support(x), F.lit(False))), lambda flags: F.filter(F.transform(lines, lambda x, i: F.when(hit(x), F.struct((i + 1).alias("line_no"), x.alias("line"), near(flags, i).alias("supported")))), lambda r: r.isNotNull()))
    return docs.select("doc_id", F.inline(once(_lines(text), rows)))


def look_ahead(docs: DataFrame, test: Test, steps: int, text: str = "text") -> DataFrame:
    """doc_id, line_no and ahead of every line: the first of the next so many lines that passes the test, else null."""
    ahead = lambda lines, flags, i: F.get(lines, i + F.nullif(F.array_position(_window(flags, i + 1, i + steps), True), F.lit(0)).cast("int"))
    rows = lambda lines: once(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), lambda flags: F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), ahead(lines, flags, i).alias("ahead"))))
    return docs.select("doc_id", F.inline(once(_lines(text), rows)))


def in_context(docs: DataFrame, opens: Test, closes: Test, reach: int, text: str = "text") -> DataFrame:
    """doc_id, line_no and context of every line: is the most recent opening line at most so many lines back, and no closing one since? A line that opens does not close."""
    state = lambda x: F.when(opens(x), 1).when(closes(x), 0)
    latest = lambda states, i: F.try_element_at(F.array_compact(_window(states, i - reach + 1, i)), F.lit(-1))
    rows = lambda lines: once(F.transform(lines, state), lambda states: F.transform(lines, lambda x, i: F.struct((i + 1).alias("line_no"), (F.coalesce(latest(states, i), F.lit(0)) == 1).alias("context"))))
    return docs.select("doc_id", F.inline(once(_lines(text), rows)))
