"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path pattern, written ``host/path``; ``*`` in the path stands for any
characters. It fits its host and all subdomains if the url's path starts with the pattern. Every
rule is kept under one of its literal tokens, the one that fewest rules share. The tokens of a url
fetch the candidate rules, and only the regular expressions of those run. All of it is Column
expressions on the row itself, so nothing is shuffled and a host with a third of all rows costs no
more than any other.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        """For host + path, with the host's labels before it."""
        host, slash, path = self.pattern.partition("/")
        body = ".*".join(re.escape(x) for x in f"{host.translate(_LOWER)}{slash}{path}".split("*"))
        # a rule without a path fits the host alone or any path below it
        return rf"(?s)\A(?:[^/]*\.)?{body}" + ("" if slash else r"(?:/.*)?\z")

    def tokens(self) -> set[str]:
        """Literal tokens that stand whole in every url that the rule fits.

        A token at the open end of the path or beside a ``*`` may go on in the url, so it is none.
        """
        host, slash, path = self.pattern.partition("/")
        found = set(re.findall(r"[a-z0-9]+", host.translate(_LOWER)))
        marked = re.sub(r"[A-Za-z0-9]*\*[A-Za-z0-9]*", "*", f"{path}*" if slash else "")
        return found | set(re.findall(r"[a-z0-9]+", marked.translate(_LOWER)))


_LOWER = str.maketrans(UPPER, LOWER)


def rule_index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rarest token of each rule (ties: the longer, then the smaller token) to the rules under it.

    Rules without a token stand under the empty one, which every url has.
    """
    shared = Counter(t for r in rules for t in r.tokens())
    index: dict[str, list[Rule]] = {}
    for r in rules:
        best = min(r.tokens(), key=lambda t: (shared[t], -len(t), t), default="")
        index.setdefault(best, []).append(r)
    return index


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row; columns of these names are replaced.

    The longest rule that fits decides (of equal lengths, the greater string); if none fits, rule is
    null and verdict is ``default``. A null url, or one without ``://``, has an empty host and path
    and fits no rule that names a host. Rows are judged one by one: repeated rows give repeated
    results, an empty table an empty one, and all other columns stay as they are. The rules are
    written by people and live in the plan.
    """
    entry = "struct<size:int,rule:string,verdict:string,regex:string>"
    pairs = []
    for token, under in sorted(rule_index(rules).items()):
        made = [F.struct(F.lit(len(r.pattern)).alias("size"), F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex")) for r in under]
        pairs += [F.lit(token), F.array(*made)]
    none = F.array().cast(f"array<{entry}>")
    index = F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,array<{entry}>>")
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    text = F.concat(F.col("host"), F.col("path"))
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1), F.array(F.lit(""))))
    candidates = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), none)))
    best = F.array_max(F.filter(candidates, lambda c: F.regexp_like(text, c["regex"])))
    hidden = "__best"
    return (
        df.withColumns({"host": host, "path": path})
        .withColumn(hidden, best)
        .withColumns({"rule": F.col(hidden)["rule"], "verdict": F.coalesce(F.col(hidden)["verdict"], F.lit(default))})
        .drop(hidden)
    )
