"""HTML extraction by consensus host paths.

In a first pass every page scores its containers and votes for the generalised tag-class path of
the best; Spark counts the votes of each host. In a second pass every page is extracted from the
elements on its host's winning paths, or, where it has none of these, from its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.url_filter import url_host

#: The head of a tag, and the rest of it where its quotes match.
HEAD = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"""(?:"[^"]*"|'[^']*'|[^>"'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("body article main section div td center blockquote".split())
#: Elements that a start tag closes if they are open in the same list, row or paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body div section article main td th table ul ol dl header footer aside nav form blockquote".split())
#: Elements that are never the article.
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe button select option optgroup datalist input textarea svg canvas object dialog menu search map audio video".split())
#: Words of class names, ids and roles of such parts of a page.
NOT_ARTICLE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidenav aside complementary footer foot colophon contentinfo "
    "masthead topbar ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored "
    "notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion "
    "pager pagination widget widgets toolbar search searchform form copyright legal disclaimer skip tags".split()
)
#: Of these, words of reader comments, and words that a paragraph of the article may bear as well.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
OF_PARAGRAPHS = frozenset("notice notices alert register search form copyright legal disclaimer skip tags subscription widget".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre table td th tr figure figcaption".split())
#: First words of names that tell how a page is laid out, not what an element is.
LAYOUT = frozenset("no has with without hide hides".split())
#: Shares of a page's text beyond which an element is the page, whatever it is named (reader comments, others), if it has so many characters.
WHOLE_COMMENTS, WHOLE, WHOLE_CHARS = 0.95, 0.6, 200
HEADER = frozenset("header heading-bar site-header pageheader".split())
KEPT_WHOLE = frozenset("html body article main".split())


def tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """Text, then the tag behind it: "/" or "", name and attributes; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes. Where a quote is never closed, that tag and all
    later ones end at the first ``>``, so every character is looked at a fixed number of times.
    """
    at = begin = 0
    quoted, last = True, source.rfind(">")
    while (lt := source.find("<", at)) >= 0:
        slash = name = rest = ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            stop = end + 3 if end >= 0 else len(source)
        elif lt > last:
            break
        elif source[lt + 1 : lt + 2] in ("!", "?"):
            stop = source.find(">", lt) + 1
        elif (m := HEAD.match(source, lt)) is not None:
            slash, name = m[1], m[2].lower()
            found = REST.match(source, m.end()) if quoted else None
            quoted = found is not None
            stop = found.end() if found else source.find(">", m.end()) + 1
            rest = source[m.end() : stop - 1]
            if name in RAW and not slash:
                end = RAW[name].search(source, stop)
                stop = source.find(">", end.end()) + 1 or len(source) if end else len(source)
        else:
            at = lt + 1
            continue
        yield source[begin:lt], slash, name, rest
        begin = at = stop
    yield source[begin:], "", "", ""


class Page:
    """The elements of a page and its blocks of text, in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#"], [-1], [False]
        self.labels, self.paths = [""], [0]  # a path is the number of its parent's path and its own label
        self.numbers: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        marks, runs = self._read(source)
        self._mark(marks, self._shares(runs))
        for parts in runs:
            kept = [(x, text, link) for x, text, link in parts if not self.dropped[x]]
            if text := " ".join("".join(t for _, t, _ in kept).split()):
                self.blocks.append((kept[0][0], text, sum(len(t) for _, t, link in kept if link)))
        self._sum()

    def _read(self, source: str) -> tuple[list[str], list[list[tuple[int, str, bool]]]]:
        """The attributes of each element, and the runs of text between block tags: element, text, in a link?"""
        tags, parents, marks = self.tags, self.parents, [""]
        stack, runs, parts = [0], [], []
        open_at: dict[str, list[int]] = {}  # places in the stack by tag
        scopes = [0]  # places in the stack of elements that bound what an end tag closes

        def cut(place: int) -> None:
            for x in stack[place:]:
                open_at[tags[x]].pop()
            del stack[place:]
            while scopes[-1] >= place:
                scopes.pop()

        def close(which: frozenset[str] | set[str]) -> None:
            """Close the nearest open element of these kinds, unless a wider one stands between."""
            place = max((open_at[t][-1] for t in which if open_at.get(t)), default=0)
            if place and place >= scopes[-1]:
                cut(place)

        for text, slash, name, rest in tokens(source):
            if text:
                parts.append((stack[-1], html.unescape(text) if "&" in text else text, bool(open_at.get("a"))))
            if name in BLOCK and parts:
                runs.append(parts)
                parts = []
            if slash:
                place = open_at[name][-1] if open_at.get(name) else 0
                if place and (name in SCOPE or place > scopes[-1]):
                    cut(place)
                continue
            if name == "br":
                parts.append((stack[-1], " ", False))
            if name in BLOCK and name not in ("html", "body"):
                close({"p"})
            if name in CLOSES:
                close(CLOSES[name])
            if not name or name in VOID or name in RAW:
                continue
            parents.append(stack[-1])
            tags.append(name)
            marks.append(rest)
            if not rest.rstrip().endswith("/"):
                open_at.setdefault(name, []).append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
                stack.append(len(tags) - 1)
        if parts:
            runs.append(parts)
        return marks, runs

    def _shares(self, runs: list[list[tuple[int, str, bool]]]) -> list[float]:
        """Of the text that stands in no element of NOT_TEXT the share that each element holds; 0 of one with few characters."""
        tags, parents = self.tags, self.parents
        out, held = [False] * len(tags), [0.0] * len(tags)
        for i in range(1, len(tags)):
            out[i] = out[parents[i]] or tags[i] in NOT_TEXT
        for parts in runs:
            for x, text, _ in parts:
                if not out[x]:
                    held[x] += len(text.strip())
        for i in range(len(tags) - 1, 0, -1):
            held[parents[i]] += held[i]
        return [h / held[0] if h >= WHOLE_CHARS else 0.0 for h in held]

    def _mark(self, marks: list[str], shares: list[float]) -> None:
        """Paths, and which elements are no part of an article or lie in one that is not.

        Names tell: any word of NOT_ARTICLE in a class, id or role. But an element that holds most of
        the page's text is the page, and what a paragraph of an article is named may be its matter.
        """
        tags, parents = self.tags, self.parents
        holds = [False] * len(tags)
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] in ("article", "main") or holds[i]:
                holds[parents[i]] = True
        inside = [False] * len(tags)
        for i in range(1, len(tags)):
            tag, up = tags[i], parents[i]
            inside[i] = inside[up] or tag == "article"
            label, words, hidden = tag, set(), False
            if marks[i]:
                found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(marks[i])}
                kind = re.sub(r"\d+", "0", " ".join(sorted(found.get("class", "").lower().split())))
                if kind:
                    label = f"{tag}.{kind.replace(' ', '.').replace('>', '_')}"
                names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split()
                each = [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower()) for n in names]
                words = {w for ws in each if ws and ws[0] not in LAYOUT for w in ws}
                hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            self.labels.append(label)
            self.paths.append(self.numbers.setdefault((self.paths[up], label), len(self.numbers) + 1))
            drop = tag in NOT_TEXT or hidden
            if tag not in KEPT_WHOLE or (tag == "article" and inside[up]):
                telling = NOT_ARTICLE.intersection(words)
                if inside[i] and tag in PARAGRAPHS:
                    telling -= OF_PARAGRAPHS
                most = WHOLE if telling.isdisjoint(COMMENTS) else WHOLE_COMMENTS
                drop = drop or bool(telling) and shares[i] < most
            if tag == "header" or not HEADER.isdisjoint(words):
                drop = drop or not inside[up] and tag not in KEPT_WHOLE
            self.dropped.append(self.dropped[up] or (drop and not holds[i]))

    def _sum(self) -> None:
        """For each element what it and those in it say: weight (links count little), characters, and those in links outside headings."""
        n = len(self.tags)
        self.weight, self.chars, self.linked = [0.0] * n, [0] * n, [0] * n
        heading, named = [False] * n, [0] * n  # named: the nearest article or main
        for i in range(1, n):
            heading[i] = heading[self.parents[i]] or re.fullmatch("h[1-6]", self.tags[i]) is not None
            named[i] = i if self.tags[i] in ("article", "main") else named[self.parents[i]]
        self.named = named
        for x, text, links in self.blocks:
            self.weight[x] += max(len(text) - links, 0) + 0.1 * min(links, len(text))
            self.chars[x] += len(text)
            self.linked[x] += 0 if heading[x] else min(links, len(text))
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            self.weight[up] += self.weight[i]
            self.chars[up] += self.chars[i]
            self.linked[up] += self.linked[i]

    def _around(self, x: int) -> int:
        """The whole article that an element is part of.

        That is the nearest article or main around it; without these, the widest element below the
        body of which no step outwards adds mostly links. What is marked as a menu, an advert and the
        like is in no block and does not count.
        """
        if self.named[x]:
            return self.named[x]
        at = x
        while (up := self.parents[at]) > 0 and self.tags[up] not in ("html", "body"):
            more = self.chars[up] - self.chars[at]
            if 2 * (self.linked[up] - self.linked[at]) > more:
                break
            at = up
            if more:
                x = at
        return x

    def best(self) -> str | None:
        """The path of the article around the deepest container of at least 60 % of what the page says; None: no text."""
        if not self.weight[0]:
            return None
        good = [i for i in range(1, len(self.tags)) if self.tags[i] in CONTAINER and self.weight[i] >= 0.6 * self.weight[0]]
        found, at = [], self._around(good[-1]) if good else 0
        while at > 0:
            found.append(self.labels[at])
            at = self.parents[at]
        return ">".join(reversed(found))

    def text(self, path: str) -> str:
        """The blocks of the articles around all elements of the path (all blocks, if it is empty), by one line end each."""
        if not path:
            return "\n".join(b for _, b, _ in self.blocks)
        number = 0
        for label in path.split(">"):
            number = self.numbers.get((number, label), -1)
        tops = {self._around(i) for i in range(1, len(self.tags)) if self.paths[i] == number and not self.dropped[i]}
        under = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            under[i] = under[self.parents[i]] or i in tops
        return "\n".join(b for x, b, _ in self.blocks if under[x])

    def extract(self, paths: list[str]) -> str:
        for p in paths:
            if text := self.text(p):
                return text
        best = self.best()
        return "" if best is None else self.text(best)


def votes(pages: DataFrame) -> DataFrame:
    """host and path: each page's vote; pages without a host or without text have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [Page(x).best() if x else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string())], names=["host", "path"])

    hosts = pages.select(url_host(F.col("url")).alias("host"), "html")
    return hosts.mapInArrow(run, "host string, path string").filter("path <> '' and host <> ''")


def winning_paths(votes_: DataFrame, percent: int = 5) -> DataFrame:
    """host and paths: those of at least so many percent of its votes, the most first; at most 100 / percent for a host."""
    counted = votes_.groupBy("host", "path").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("host"))
    kept = counted.withColumn("total", total).filter(100 * F.col("n") >= percent * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return kept.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every row: the article's blocks, in page order, one to a line.

    Character references are decoded and white space inside a block is one space. A null or empty
    page, and one that has only menus, adverts and the like, has an empty text. Of a host, the path
    with most votes that a page has counts (ties: the smaller path). Pages without a host are
    extracted by their own best container. Repeated rows vote and are extracted each; an empty
    table gives an empty result; columns besides page_id, url and html are not read. The table of
    winning paths, a few for each host, is written first: Spark broadcasts it if it is small and
    otherwise joins by host and splits the hot ones.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", F.col(url).alias("url"), F.col(source).alias("html"))
    paths = Scratch(spark, "html").save(winning_paths(votes(pages)), "paths").withColumnRenamed("host", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(x).extract(p or []) if x else "" for x, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.join(paths, url_host(F.col("url")) == F.col("of"), "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
