"""Ways through document trees: nodes by text, section, table, row, column and note, and what lies above and below them.

All functions take the nodes of document_tree.nodes(docs, paths=True), whole corpora at once, and
look at nodes by themselves: what lies above a node is in its path, so nothing is joined but rows
with the cells in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once
from tallyloom.sources.shared import saved


def _nearest(kind: str, field: str = "key") -> Column:
    return F.try_element_at(F.filter("path", lambda s: s["type"] == kind), F.lit(-1))[field]


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """Adds section and table (keys of the nearest above or at the node), section_title, row_label and column (the name of its column)."""
    last = lambda field: F.get("path", F.size("path") - 1)[field]
    return nodes.withColumns({"section": _nearest("section"), "section_title": _nearest("section", "label"), "table": _nearest("table"), "row_label": _nearest("row", "label"), "column": last("column")})


def shown_path() -> Column:
    """type[label or column] of every step from the document down, as one text."""
    name = lambda s: F.coalesce(s["label"], s["column"], F.lit(""))
    step = lambda s: F.concat(s["type"], F.when(name(s) != "", F.concat(F.lit("["), name(s), F.lit("]"))).otherwise(""))
    return F.array_join(F.transform("path", step), " > ")


def structural_path(nodes: DataFrame) -> DataFrame:
    """doc_id, key and structural_path of every node."""
    return nodes.select("doc_id", "key", shown_path().alias("structural_path"))


def with_ways(nodes: DataFrame, ways: dict[str, Column], first: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, way and key of the nodes that each test says yes to, of the ways in first only each document's first node; all in one pass.

    Nodes need not be kept: a node meets all tests where it is made, and only hits are dealt out.
    """
    of = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(way)) for way, test in ways.items()])))
    hits = nodes.select("doc_id", "order", "key", of.alias("way")).groupBy("doc_id", "way").agg(F.array_sort(F.collect_list(F.struct("order", "key"))).alias("hits"))
    return hits.select("doc_id", "way", F.explode(F.when(F.col("way").isin(*first), F.slice("hits", 1, 1)).otherwise(F.col("hits"))).alias("h")).select("doc_id", "way", "h.key")


def _of_kind(test: Column, kind: str | None) -> Column:
    return (F.col("node_type") == kind) & test if kind else test


def has_text(text: str, exact: bool = False, kind: str | None = None) -> Column:
    low = F.lower("text")
    return _of_kind(low == text.lower() if exact else low.contains(text.lower()), kind)


def find_by_text(nodes: DataFrame, text: str, exact: bool = False, kind: str | None = None) -> DataFrame:
    """Nodes whose text contains the words (exact: is them), upper and lower case alike, of one type if given."""
    return nodes.filter(has_text(text, exact, kind))


def first_of_each(nodes: DataFrame) -> DataFrame:
    """Of each document the node that comes first."""
    least = nodes.groupBy("doc_id").agg(F.min("order").alias("order"))
    return nodes.join(least, ["doc_id", "order"])


def find_section(nodes: DataFrame, title: str) -> DataFrame:
    return first_of_each(find_by_text(nodes, title, kind="section"))


def is_table(text: str) -> Column:
    return _of_kind(F.lower("text").contains(text.lower()) | F.lower(_nearest("section", "label")).contains(text.lower()), "table")


def find_table(nodes: DataFrame, text: str) -> DataFrame:
    """Of each document the first table whose header, or whose section's title, contains the words."""
    return first_of_each(nodes.filter(is_table(text)))


def is_within(title: str, kind: str) -> Column:
    return _of_kind(F.exists("path", lambda s: (s["type"] == "section") & F.lower(s["label"]).contains(title.lower())), kind)


def within_section(nodes: DataFrame, title: str, kind: str) -> DataFrame:
    """Nodes of a type anywhere below sections whose title contains the words."""
    return nodes.filter(is_within(title, kind))


def is_below(key: str, kind: str | None = None) -> Column:
    return _of_kind((F.col("key") != key) & F.exists("path", lambda s: s["key"] == key), kind)


def below(nodes: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """All nodes below the one of this key, of one type if given."""
    return nodes.filter(is_below(key, kind))


def children(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.filter(F.col("parent") == key)


def siblings(nodes: DataFrame) -> DataFrame:
    """doc_id, key, before and after: the neighbours of each node among the children of its parent, and n_siblings, itself included."""
    by = Window.partitionBy("doc_id", "parent").orderBy("order")
    many = Window.partitionBy("doc_id", "parent")
    return nodes.filter("parent is not null").select("doc_id", "key", F.lag("key").over(by).alias("before"), F.lead("key").over(by).alias("after"), F.count("*").over(many).alias("n_siblings"))


def is_row(label: str) -> Column:
    return _of_kind(F.lower(_nearest("row", "label")).contains(label.lower()), "row")


def find_rows(nodes: DataFrame, label: str) -> DataFrame:
    """Rows whose label contains the words."""
    return nodes.filter(is_row(label))


def is_cell(row: str | None = None, column: str | None = None, text: str | None = None) -> Column:
    test = F.exists("path", lambda s: s["type"] == "row")
    for words, value in ((row, F.lower(_nearest("row", "label"))), (column, F.lower(F.get("path", F.size("path") - 1)["column"])), (text, F.lower("text"))):
        if words is not None:
            test = test & value.contains(words.lower())
    return _of_kind(test, "cell")


def find_cells(nodes: DataFrame, row: str | None = None, column: str | None = None, text: str | None = None) -> DataFrame:
    """Cells of body rows by the label of their row, the name of their column and their own text; what is None does not count."""
    return nodes.filter(is_cell(row, column, text))


def note_number(title: Column) -> Column:
    """The number of a note that a heading or a paragraph begins with: 12 of "12. Borrowings" and of "Note 12: Borrowings"; null if there is none."""
    return F.nullif(F.regexp_extract(title, r"(?i)^\s*(?:note\s*(?:no\.?)?\s*)?(\d+[a-z]?)\s*[.:)\-]?\s+\S", 1), F.lit(""))


def note_targets(nodes: DataFrame) -> DataFrame:
    """doc_id, note, row and target: rows that refer to a note, with the section or paragraph that the note is (null if the document has none).

    Of several targets the first counts. Notes and targets meet on document and number, in one pass over the nodes.
    """
    is_note = F.col("node_type") == "note"
    of = F.when(is_note, F.regexp_replace("text", "^Note ", "")).when(F.col("node_type").isin("section", "paragraph"), note_number(F.col("text")))
    told = nodes.filter("node_type in ('note', 'section', 'paragraph')").select("doc_id", of.alias("note"), "order", "key", F.when(is_note, F.col("parent")).alias("row")).filter("note is not null")
    met = told.groupBy("doc_id", "note").agg(F.collect_list("row").alias("rows"), F.min_by(F.when(F.col("row").isNull(), F.col("key")), F.when(F.col("row").isNull(), F.col("order"))).alias("target"))
    return met.select("doc_id", "note", F.explode("rows").alias("row"), "target")


def names_note(note: str) -> Column:
    return _of_kind(F.lower("text") == f"note {note.lower()}", "note")


def rows_of_note(nodes: DataFrame, note: str) -> DataFrame:
    """Rows that refer to the note of this number."""
    return nodes.filter(names_note(note)).select("doc_id", F.col("parent").alias("row"))


def summary(nodes: DataFrame) -> DataFrame:
    """Nodes of each type and the greatest depth, for each document."""
    return nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


def variable_search(nodes: DataFrame, variables: list[str]) -> DataFrame:
    """doc_id, variable, status and structural_path: FOUND where a row's label contains the words and a cell behind it has a figure, PARTIAL where they stand anywhere else, else NOT_FOUND.

    One pass over the nodes tests all variables; of each node only what it says of them goes on, and of each document its best.
    """
    label = F.lower(F.coalesce(_nearest("row", "label"), F.lit("")))
    figure = (F.col("node_type") == "cell") & (F.col("col_no") > 0) & F.col("text").rlike(r"\d") & (F.get("path", F.size("path") - 2)["type"] == "row")
    low = F.lower("text")
    cell = F.when(figure, label).otherwise("")
    tests = [F.when(F.col("label").contains(v.lower()), F.lit(0)).when(F.col("low").contains(v.lower()), F.lit(1)) for v in variables]
    told = nodes.select("doc_id", "order", "node_type", "path", cell.alias("label"), low.alias("low")).select("doc_id", "order", "node_type", "path", F.array(*tests).alias("ranks"))
    hits = told.filter(F.exists("ranks", lambda r: r.isNotNull()) | (F.col("node_type") == "document")).select("doc_id", "order", "ranks", shown_path().alias("structural_path"))
    best = hits.groupBy("doc_id").agg(*[F.min(F.when(F.get("ranks", F.lit(i)).isNotNull(), F.struct(F.get("ranks", F.lit(i)).alias("rank"), "order", "structural_path"))).alias(f"b{i}") for i in range(len(variables))])
    each = best.select("doc_id", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"b{i}").alias("b")) for i, v in enumerate(variables)])).alias("v")).select("doc_id", "v.*")
    status = F.when(F.col("b.rank") == 0, "FOUND").when(F.col("b.rank") == 1, "PARTIAL").otherwise("NOT_FOUND")
    return each.select("doc_id", "variable", status.alias("status"), F.col("b.structural_path").alias("structural_path"))


#: Years that column names are searched for, the current one and the one before, in this order.
YEAR_PAIRS = [("2025", "2024"), ("2022", "2021"), ("2023", "2022"), ("2024", "2023")]


def _year_values(cells: Column) -> Column:
    """current and previous of a row's cells (column, text): by years in the columns' names, else the last two cells with a figure."""
    filled = F.filter(cells, lambda c: ~c["text"].isin("", "(empty)"))
    last = lambda found: F.try_element_at(found, F.lit(-1))["text"]

    def of_years(now: str, before: str) -> Column:
        current = last(F.filter(filled, lambda c: c["column"].contains(now)))
        previous = last(F.filter(filled, lambda c: c["column"].contains(before) & ~c["column"].contains(now)))
        return F.when(current.isNotNull() | previous.isNotNull(), F.struct(F.coalesce(current, F.lit("")).alias("current"), F.coalesce(previous, F.lit("")).alias("previous")))

    figures = F.transform(F.filter(cells, lambda c: c["text"].rlike("[0-9]")), lambda c: c["text"])
    nth = lambda f, k: F.coalesce(F.try_element_at(f, F.lit(k)), F.lit(""))
    by_place = lambda f: F.when(F.size(f) > 1, F.struct(nth(f, -2).alias("current"), nth(f, -1).alias("previous"))).otherwise(F.struct(nth(f, -1).alias("current"), F.lit("").alias("previous")))
    return F.coalesce(*[of_years(*years) for years in YEAR_PAIRS], once(figures, by_place))


def _row_score(text: Column, values: Column, words: str) -> Column:
    """How well a row states a variable: two values +10, one of them no number -100, a month's name -50, a dot -5; the words alone +5, a total or net of them +8."""
    now, before = values["current"], values["previous"]
    either = lambda test: test(now) | test(before)
    both = (now != "") & (before != "")
    of_values = 10 - F.when(either(lambda v: ~F.translate(v, ",.-", "").rlike(r"^\s*[0-9]+\s*$")), 100).otherwise(0) - F.when(either(lambda v: F.lower(v).contains("march")), 50).otherwise(0) - F.when(either(lambda v: v.contains(".")), 5).otherwise(0)
    of_text = F.when((text == words) | text.contains(f"| {words}"), 5).when(text.contains(f"total {words}") | text.contains(f"{words} (net)"), 8).otherwise(0)
    return F.when(both, of_values).otherwise(0) + of_text


def best_rows(nodes: DataFrame, variables: list[str]) -> DataFrame:
    """doc_id, variable, row, current, previous, score and status: of each document the row that states a variable best.

    Rows whose label contains the words count, without any the rows with such a cell; of these the
    one of the highest score, ties to the first. status is FOUND with a current value, else PARTIAL.
    A variable that no document has is one row NOT_FOUND without a document.

    The cells of each row meet once; a row is then tested for all variables in place.
    """
    cells = nodes.filter("node_type = 'cell'").filter(F.get("path", F.size("path") - 2)["type"] == "row")
    cell = F.struct("col_no", F.lower(F.coalesce(F.get("path", F.size("path") - 1)["column"], F.lit(""))).alias("column"), F.trim("text").alias("text"))
    rows = cells.groupBy("doc_id", F.col("parent").alias("row")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.min("order").alias("order"))
    return _best_of(rows, variables)


def best_table_rows(tables: DataFrame, variables: list[str]) -> DataFrame:
    """The same as best_rows, from document_tree.parsed_tables(docs): the cells of a row lie together there, and only hits are dealt out."""
    each = tables.select("doc_id", "block_no", F.get("rows", F.lit(0)).alias("head"), F.posexplode("rows").alias("row_no", "r")).filter("row_no > 0")
    cell = lambda v, c: F.struct(c.alias("col_no"), F.lower(F.coalesce(F.get("head", c), F.lit(""))).alias("column"), F.trim(v).alias("text"))
    row = F.concat_ws("/", F.lit("row"), "block_no", "row_no")
    return _best_of(each.select("doc_id", row.alias("row"), F.struct("block_no", "row_no").alias("order"), F.transform("r", cell).alias("cells")), variables)


def _best_of(rows: DataFrame, variables: list[str]) -> DataFrame:
    """best_rows of rows with their cells (col_no, column, text) in order."""
    shown = F.filter(F.transform(F.slice("cells", 1, 2), lambda c: c["text"]), lambda t: t != "")
    rows = rows.select("doc_id", "row", "order", "cells", F.lower(F.array_join(shown, " | ")).alias("text"), F.lower(F.coalesce(F.get(shown, F.lit(0)), F.lit(""))).alias("label"), _year_values(F.col("cells")).alias("values"))

    def test(variable: str) -> Column:
        words = variable.strip().lower()
        tier = F.when(F.col("label").contains(words), 0).when(F.exists("cells", lambda c: F.lower(c["text"]).contains(words)), 1)
        return F.when(tier.isNotNull(), F.struct(F.lit(variable).alias("variable"), tier.alias("tier"), _row_score(F.col("text"), F.col("values"), words).alias("score")))

    hits = rows.select("doc_id", "row", "order", "values", F.explode(F.array_compact(F.array(*map(test, variables)))).alias("v"))
    best = hits.groupBy("doc_id", "v.variable").agg(F.min(F.struct("v.tier", (-F.col("v.score")).alias("less"), "order", "row", "values")).alias("b"))
    found = best.select("doc_id", "variable", "b.row", "b.values.current", "b.values.previous", (-F.col("b.less")).alias("score"), F.when(F.col("b.values.current") != "", "FOUND").otherwise("PARTIAL").alias("status"))
    found = saved(found, "best")  # read twice
    wanted = rows.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    absent = wanted.join(found.select("variable").distinct(), "variable", "left_anti")
    none = F.lit(None).cast("string")
    return found.unionByName(absent.select(F.lit(None).cast("long").alias("doc_id"), "variable", none.alias("row"), none.alias("current"), none.alias("previous"), F.lit(None).cast("int").alias("score"), F.lit("NOT_FOUND").alias("status")))
