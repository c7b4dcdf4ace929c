"""Markdown documents to lines, blocks, sections, tables, nodes and edges.

A document lies in one row. ``parsed`` keeps it there: its blocks, sections and tables are arrays of
that row, so tables, sections and nodes need neither a shuffle nor a window. Lines and blocks as
rows of their own are for tables that begin with lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.arrays import once, places, runs
from tallyloom.functions.cleaning import strip_markup

#: Column names that hold note numbers.
NOTE_COLUMNS = ("note", "notes", "note no", "note no.", "notes no.", "ref", "ref.")
INLINE_NOTE = r"(?i)\b(?:note|ref)\.? *(?:no\.? *)?(\d+[a-z]?)\b"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1) and line; a null text has no line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\f\r"))


def _kind(t: Column) -> Column:
    return (
        F.when(t == "", "blank").when(t.startswith("![") & t.rlike(r"^!\[.*?\]\(.*?\)"), "image").when(t.startswith("#") & t.rlike(r"^#{1,6}\s+"), "heading")
        .when(t.startswith("|"), F.when(t.rlike(r"^\|[\s\-:|]+\|$"), "separator").otherwise("table")).otherwise("paragraph")
    )


def _level(t: Column) -> Column:
    """The depth of a heading."""
    return F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1))


def line_kinds(lines_: DataFrame) -> DataFrame:
    """Adds kind (blank, image, heading, separator, table, paragraph, tested in that order) and level, the heading's depth or 0."""
    t = _bare(F.col("line"))
    return lines_.withColumn("kind", _kind(t)).withColumn("level", F.when(F.col("kind") == "heading", _level(t)).otherwise(0))


def parsed(docs: DataFrame, bold_headings: bool = False) -> DataFrame:
    """doc_id, what else docs have, and sections: an array of section_no, level, title, parent_no and blocks (block_no, kind, level, line_no, content, lines).

    Runs of table lines, and of paragraph lines, are one block each; a heading is its own; blanks and
    images break runs and vanish. A section begins at each heading, and section 0, the preamble, has
    what stands before (it is left out where nothing does). parent_no is the nearest earlier section
    of a smaller level, else null. bold_headings: a line that is all bold is a heading of level 6. A
    null text has no section. Levels of the sections of one document are walked through once, with
    a list that grows by one entry each.
    """
    bold = r"^\*\*[^*]+\*\*:?$"
    kind_of = lambda t: F.when(t.startswith("|"), "table").otherwise(_kind(t))  # a separator is a line of its table
    family = lambda t: F.when(t.rlike(bold), "heading").otherwise(kind_of(t)) if bold_headings else kind_of(t)
    level = lambda t: F.when(t.rlike(r"^#"), _level(t)).otherwise(6)
    line = lambda raw: once(_bare(raw), lambda t: F.struct(raw.alias("raw"), family(t).alias("family"), t.alias("bare")))

    def blocks_of(rows: Column) -> Column:
        kind = lambda i: F.get(rows, i)["family"]
        starts = F.filter(places(rows), lambda i: (i == 0) | (kind(i) == "heading") | (kind(i) != kind(i - 1)))
        spans = once(starts, lambda s: F.filter(runs(F.size(rows), s), lambda r: ~kind(r["first"]).isin("blank", "image")))

        def block(r: Column, j: Column) -> Column:
            own = F.slice(rows, r["first"] + 1, r["size"])
            head = kind(r["first"]) == "heading"
            title = strip_markup(F.regexp_replace(F.get(rows, r["first"])["bare"], r"^#{1,6}\s+", ""))
            text = F.when(kind(r["first"]) == "table", "").when(head, title).otherwise(F.array_join(F.transform(own, lambda x: F.trim(x["raw"])), " "))
            depth = F.when(head, level(F.get(rows, r["first"])["bare"])).otherwise(0)
            return F.struct((j + 1).alias("block_no"), kind(r["first"]).alias("kind"), depth.alias("level"), (r["first"] + 1).alias("line_no"), text.alias("content"), F.transform(own, lambda x: x["raw"]).alias("lines"))

        return F.transform(spans, block)

    def sections_of(all_: Column) -> Column:
        heads = F.filter(places(all_), lambda i: F.get(all_, i)["kind"] == "heading")
        cut = F.transform(once(F.concat(F.array(F.lit(0)), heads), lambda s: runs(F.size(all_), s)), lambda r, m: F.struct(m.alias("section_no"), F.slice(all_, r["first"] + 1, r["size"]).alias("blocks")))
        filled = F.filter(cut, lambda x: F.size(x["blocks"]) > 0)
        first = lambda x: F.get(x["blocks"], F.lit(0))
        depth = lambda x: F.when(x["section_no"] == 0, 0).otherwise(first(x)["level"])

        def with_parents(parts: Column) -> Column:
            start = F.struct(F.array_repeat(F.lit(None).cast("int"), 7).alias("last"), F.array().cast("array<int>").alias("up"))
            step = lambda acc, x: F.struct(
                F.transform(acc["last"], lambda v, k: F.when(k == depth(x), x["section_no"]).otherwise(v)).alias("last"),
                F.concat(acc["up"], F.array(F.array_max(F.slice(acc["last"], 1, depth(x))))).alias("up"),
            )
            title = lambda x: F.when(x["section_no"] == 0, "Preamble").otherwise(first(x)["content"])
            made = lambda up: F.transform(parts, lambda x, i: F.struct(x["section_no"], depth(x).alias("level"), title(x).alias("title"), F.get(up, i).alias("parent_no"), x["blocks"]))
            return once(F.aggregate(parts, start, step, lambda acc: acc["up"]), made)

        return once(filled, with_parents)

    rows = F.transform(F.split("text", "\r?\n"), line)
    return docs.select(*[c for c in docs.columns if c != "text"], once(once(rows, blocks_of), sections_of).alias("sections"))


def parsed_tables(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, block_no, caption (the section's title) and rows: the cells of each line of a table, the header first; all have the header's width."""
    # what is exploded is no plain column and nothing is filtered after it: Spark would filter below, and compute it once more for that
    some = F.filter("sections", lambda s: F.exists(s["blocks"], lambda b: b["kind"] == "table"))
    each = parsed(docs).select("doc_id", F.explode(some).alias("s")).select("doc_id", "s.section_no", F.col("s.title").alias("caption"), F.explode(F.filter("s.blocks", lambda b: b["kind"] == "table")).alias("b"))
    return each.select("doc_id", "section_no", "b.block_no", "caption", F.explode(F.filter(F.array(rows_of(F.col("b.lines"))), lambda rows: F.size(rows) > 0)).alias("rows"))


def rows_of(table_lines: Column) -> Column:
    """The cells of a table's lines without separators, padded or cut to the width of the first."""
    content = F.filter(table_lines, lambda x: ~F.trim(x).rlike(r"^\|?[\s\-:|]+\|?$"))
    cut = F.transform(content, lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1))
    wide = lambda rows: F.transform(rows, lambda r: F.transform(places(F.get(rows, F.lit(0))), lambda c: F.coalesce(strip_markup(F.get(r, c)), F.lit(""))))
    return once(cut, wide)


def notes_of(head: Column, row: Column) -> Column:
    """The notes that the cells of a row name, in order: what stands in columns of notes, and notes within other texts."""
    in_column = lambda c: F.lower(F.get(head, c)).isin(*NOTE_COLUMNS)
    return F.filter(F.transform(row, lambda v, c: _note_in(v, in_column(c))), lambda n: n != "")


def _note_in(v: Column, in_column: Column) -> Column:
    return F.when(in_column & (F.trim(v) != ""), F.trim(v)).when(F.lower(v).rlike("note|ref"), F.regexp_extract(v, INLINE_NOTE, 1)).otherwise("")


def document_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, level, title and parent_no of every section."""
    return parsed(docs).select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section_no", "s.level", "s.title", "s.parent_no")


def document_cells(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no (0 is the header), col_no, header and value of all tables."""
    each = parsed_tables(docs).select("doc_id", "block_no", F.get("rows", F.lit(0)).alias("head"), F.posexplode("rows").alias("row_no", "row"))
    return each.select("doc_id", "block_no", "row_no", F.posexplode("row").alias("col_no", "value"), "head").select("doc_id", "block_no", "row_no", "col_no", F.get("head", F.col("col_no")).alias("header"), "value")


def blocks(kinds: DataFrame) -> DataFrame:
    """Runs of table lines, and of paragraph lines, become one block each; a heading is its own; blanks and images break runs and vanish.

    doc_id, block_no (from 1), kind, level, line_no (the first), content and lines.
    """
    by = Window.partitionBy("doc_id").orderBy("line_no")
    family = F.when(F.col("kind") == "separator", "table").otherwise(F.col("kind"))
    starts = (F.col("family") == "heading") | F.col("before").isNull() | (F.col("family") != F.col("before"))
    runs = kinds.withColumn("family", family).withColumn("before", F.lag("family").over(by)).withColumn("run", F.sum(starts.cast("int")).over(by)).filter(~F.col("family").isin("blank", "image"))
    text = F.when(F.col("level") > 0, strip_markup(F.regexp_replace("line", r"^\s*#{1,6}\s+", ""))).otherwise(F.trim("line"))
    merged = runs.groupBy("doc_id", "run").agg(F.first("family").alias("kind"), F.max("level").alias("level"), F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", F.col("line").alias("raw"), text.alias("text")))).alias("all"))
    content = F.when(F.col("kind") == "table", "").otherwise(F.array_join(F.col("all.text"), " "))
    return merged.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("run")).alias("block_no"), "kind", "level", "line_no", content.alias("content"), F.col("all.raw").alias("lines"))


def sections(blocks_: DataFrame) -> DataFrame:
    """Blocks with section_no: that of the latest heading. 0, the preamble, stands before any heading."""
    by = Window.partitionBy("doc_id").orderBy("block_no")
    return blocks_.withColumn("section_no", F.sum((F.col("kind") == "heading").cast("int")).over(by).cast("int"))


def section_tree(sections_: DataFrame) -> DataFrame:
    """doc_id, section_no, level, title and parent_no: the nearest earlier section of a smaller level, else null.

    The preamble has level 0 and so becomes the ancestor of all later sections.
    """
    heads = sections_.groupBy("doc_id", "section_no").agg(F.max("level").alias("level"), F.min_by("content", "block_no").alias("first"))
    heads = heads.withColumn("title", F.when(F.col("section_no") == 0, "Preamble").otherwise(F.col("first")))
    before = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("section_no")), ignorenulls=True).over(before)) for k in range(6)]
    return heads.select("doc_id", "section_no", "level", "title", F.greatest(*nearest).alias("parent_no"))


def table_cells(blocks_: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no (0 is the header), col_no, header and value of all tables; rows are padded or cut to the header's width."""
    tables = blocks_.filter("kind = 'table'")
    content = F.filter("lines", lambda x: ~F.trim(x).rlike(r"^\|?[\s\-:|]+\|?$"))
    cut = lambda x: F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1)
    rows = tables.select("doc_id", "block_no", F.transform(content, cut).alias("rows")).filter(F.size("rows") > 0)
    rows = rows.withColumn("head", F.transform(F.element_at("rows", 1), strip_markup))
    each = rows.select("doc_id", "block_no", "head", F.posexplode("rows").alias("row_no", "row"))
    return each.select("doc_id", "block_no", "row_no", F.posexplode("head").alias("col_no", "header"), "row").select("doc_id", "block_no", "row_no", "col_no", "header", F.coalesce(strip_markup(F.get("row", F.col("col_no"))), F.lit("")).alias("value"))


def table_rows(cells: DataFrame) -> DataFrame:
    """doc_id, block_no, row_no, row_label (first filled of the first two cells), text, n_cells and notes, for body rows."""
    filled = F.filter(F.slice("values", 1, 2), lambda v: F.trim(v) != "")
    rows = cells.groupBy("doc_id", "block_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "header", "value"))).alias("cells")).withColumn("values", F.col("cells.value"))
    is_note = lambda c: F.lower(F.trim(c["header"])).isin(*NOTE_COLUMNS) & (F.trim(c["value"]) != "")
    inline = lambda c: F.regexp_extract(c["value"], INLINE_NOTE, 1)
    notes = F.filter(F.transform("cells", lambda c: F.when(is_note(c), F.trim(c["value"])).otherwise(inline(c))), lambda n: n != "")
    return rows.select("doc_id", "block_no", "row_no", F.coalesce(F.get(filled, F.lit(0)), F.lit("")).alias("row_label"), F.array_join(filled, " | ").alias("text"), F.size("cells").alias("n_cells"), F.when(F.col("row_no") > 0, notes).otherwise(F.array().cast("array<string>")).alias("notes"))


def nodes(docs: DataFrame, paths: bool = False) -> DataFrame:
    """doc_id, order, node_type, key, parent, text, col_no, in_column and depth of every node of every document.

    paths: also path, the steps from the document down to the node, each with type, key, text (at
    most 80 characters), label (of a section its title, of a row its label) and column (of a cell
    the name of its column).

    order is the place in a walk through the tree, parents first. key and parent name a node in its
    document, as ``row/3/1``. in_column: does the header name the column of a cell? depth counts from
    the document, 0. Nothing is shuffled; ``numbered`` adds ids.
    """
    # not the plain column: Spark would look at its size first, and make all nodes once more for that
    return trees(docs, paths).select("doc_id", F.posexplode(F.filter("nodes", lambda _: F.lit(True))).alias("order", "n")).select("doc_id", "order", "n.*")


def trees(docs: DataFrame, paths: bool = False) -> DataFrame:
    """doc_id, what else docs have, and nodes: those of ``nodes`` in their order, in the document's row."""
    zero, no, none = F.lit(0), F.lit(False), F.lit(None)
    key = lambda kind, *c: F.concat_ws("/", F.lit(kind), *c)

    def node(kind: Column | str, name: Column, parent: Column, text: Column, depth: Column, col_no: Column = none, in_column: Column = no, above: Column | None = None, label: Column = none, column: Column = none) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        made = [kind.alias("node_type"), name.alias("key"), parent.cast("string").alias("parent"), text.alias("text"), depth.cast("int").alias("depth"), col_no.cast("int").alias("col_no"), in_column.alias("in_column")]
        if paths:
            own = F.array(step(kind, name, text, label, column))
            made.append((own if above is None else F.concat(above, own)).alias("path"))
        return F.struct(*made)

    def step(kind: Column, name: Column, text: Column, label: Column = none, column: Column = none) -> Column:
        return F.struct(kind.alias("type"), name.alias("key"), F.substring(text, 1, 80).alias("text"), label.cast("string").alias("label"), column.cast("string").alias("column"))

    def of_table(b: Column, s: Column) -> Column:
        no_, deep = b["block_no"], s["depth"]

        def lines_of(rows: Column, on_table: Column | None) -> Column:
            head = F.get(rows, zero)
            row_kind = lambda i: F.when(i == 0, "header").otherwise("row")

            # what a line and its way say is computed once, not again for each of its cells
            def line(r: Column, i: Column) -> Column:
                filled = F.filter(F.slice(r, 1, 2), lambda v: F.trim(v) != "")
                made = lambda own: once(F.struct(own["name"].alias("name"), own["text"].alias("text"), own["label"].alias("label"), *([F.concat(on_table, F.array(step(row_kind(i), own["name"], own["text"], own["label"]))).alias("path")] if paths else [])), lambda o: of_line(r, i, o))
                name = F.when(i == 0, key("header", no_)).otherwise(key("row", no_, i))
                of_row = lambda f: F.struct(name.alias("name"), F.when(i == 0, "").otherwise(F.array_join(f, " | ")).alias("text"), F.when(i > 0, F.coalesce(F.get(f, zero), F.lit(""))).alias("label"))
                return once(once(filled, of_row), made)

            def of_line(r: Column, i: Column, o: Column) -> Column:
                on_row = o["path"] if paths else None
                cell = lambda v, c: node("cell", key("cell", no_, i, c), o["name"], v, deep + 3, c, F.trim(F.get(head, c)) != "", on_row, none, F.get(head, c))
                self_ = node(row_kind(i), o["name"], key("table", no_), o["text"], deep + 2, above=on_table, label=o["label"])
                # a line whose cells name no note, and which has no cell in a column of notes, has none
                note = lambda n, j: node("note", key("note", no_, i, j), o["name"], F.concat(F.lit("Note "), n), deep + 3, above=on_row)
                notes = F.transform(F.filter(F.transform(r, note_in), lambda n: n != ""), note)
                return F.concat(F.array(self_), F.transform(r, cell), F.when(i > 0, notes).otherwise(F.slice(notes, 1, 0)))

            # places of columns of notes, once for each table
            def with_notes(note_columns: Column) -> Column:
                nonlocal note_in
                note_in = lambda v, c: _note_in(v, F.array_contains(note_columns, c))
                table = node("table", key("table", no_), key("section", s["section_no"]), F.array_join(head, " | "), deep + 1, above=s["path"])
                return F.when(F.size(rows) > 0, F.concat(F.array(table), F.flatten(F.transform(rows, line))))

            note_in = None
            return once(F.filter(places(head), lambda c: F.lower(F.get(head, c)).isin(*NOTE_COLUMNS)), with_notes)

        def with_way(rows: Column) -> Column:
            if not paths:
                return lines_of(rows, None)
            way = F.concat(s["path"], F.array(step(F.lit("table"), key("table", no_), F.array_join(F.get(rows, zero), " | "))))
            return once(way, lambda w: lines_of(rows, w))

        return once(rows_of(b["lines"]), with_way)

    def of_section(s: Column, all_: Column) -> Column:
        name = key("section", s["section_no"])
        paragraph = lambda b: F.array(node("paragraph", key("paragraph", b["block_no"]), name, b["content"], s["depth"] + 1, above=s["path"]))
        of_block = lambda b: F.when(b["kind"] == "table", of_table(b, s)).when((b["kind"] == "paragraph") & (F.trim(b["content"]) != ""), paragraph(b))
        up = F.when(s["parent_no"].isNull(), "document").otherwise(key("section", s["parent_no"]))
        over = F.slice(s["path"], 1, F.size(s["path"]) - 1)
        start = F.array(node("section", name, up, s["title"], s["depth"], above=over, label=s["title"]), node("heading", key("heading", s["section_no"]), name, s["title"], s["depth"] + 1, above=s["path"]))
        return F.concat(start, F.flatten(F.array_compact(F.transform(s["blocks"], of_block))))

    # the way down to a section: that of its parent, and itself; sections without a gap, so a number tells the place
    def deep(parts: Column) -> Column:
        root = F.array(step(F.lit("document"), F.lit("document"), F.lit("")))
        start = F.get(parts, zero)["section_no"]
        down = lambda acc, x: F.concat(F.coalesce(F.get(acc, x["parent_no"] - start), root), F.array(step(F.lit("section"), key("section", x["section_no"]), x["title"], x["title"])))
        add = lambda acc, x: F.concat(acc, F.array(down(acc, x)))
        kind = "array<array<struct<type:string,key:string,text:string,label:string,column:string>>>"
        made = lambda ways: F.transform(parts, lambda x, i: F.struct(x["section_no"], x["title"], x["parent_no"], x["blocks"], F.get(ways, i).alias("path"), (F.size(F.get(ways, i)) - 1).alias("depth")))
        return once(F.aggregate(parts, F.array().cast(kind), add), made)

    document = F.array(node("document", F.lit("document"), none, F.lit(""), zero))
    empty = F.slice(document, 1, 0)
    all_ = F.concat(document, F.coalesce(F.flatten(F.transform(once(F.col("sections"), deep), lambda s: of_section(s, s))), empty))
    return parsed(docs).select(*[c for c in docs.columns if c != "text"], all_.alias("nodes"))


def numbered(nodes_: DataFrame) -> DataFrame:
    """Adds node_id: the type and the number of the node among those of its type, in document order, as ``row_14``."""
    by = Window.partitionBy("doc_id", "node_type").orderBy("order")
    return nodes_.withColumn("node_id", F.concat_ws("_", "node_type", F.row_number().over(by)))


def edges(nodes_: DataFrame) -> DataFrame:
    """doc_id, src, dst and rel: ownership, adjacency and meaning, 16 kinds.

    Nodes are dealt by document once, and no node meets another in a join: the parent of a node is
    the latest node of its kind before it, or, for a section, told by its number, as the sections of
    a document are numbered without a gap from the preamble, or else from 1.
    """
    by = Window.partitionBy("doc_id").orderBy("order")
    kind = F.col("node_type")
    line, cell = kind.isin("row", "header"), kind == "cell"
    own = nodes_.repartition("doc_id").withColumn("family", F.when(line, "line").otherwise(kind))
    sibling = Window.partitionBy("doc_id", "family").orderBy("order")
    if "node_id" not in nodes_.columns:
        # the ids of numbered, in the order of siblings, so that nodes are sorted for both at once
        so_far = lambda t: F.count(F.when(kind == t, 1)).over(sibling.rowsBetween(Window.unboundedPreceding, 0))
        number_ = F.when(kind == "header", so_far("header")).when(kind == "row", so_far("row")).otherwise(F.row_number().over(sibling))
        own = own.withColumn("node_id", F.concat_ws("_", "node_type", number_.cast("string")))
    same = F.lead("parent").over(sibling) == F.col("parent")
    own = own.withColumn("next_id", F.when(same & (line | cell), F.lead("node_id").over(sibling)))
    latest = lambda *kinds: F.last(F.when(kind.isin(*kinds), F.col("node_id")), ignorenulls=True).over(by)
    number = lambda c: F.regexp_extract(c, r"^section/(\d+)$", 1).try_cast("int")
    first = F.min(F.when(kind == "section", number("key"))).over(Window.partitionBy("doc_id"))
    of_section = F.coalesce(F.concat(F.lit("section_"), (number("parent") - first + 1).cast("string")), F.lit("document_1"))
    above = F.when(kind == "section", of_section).when(kind.isin("paragraph", "table", "heading"), latest("section"))
    above = above.when(kind.isin("row", "header"), latest("table")).when(kind.isin("cell", "note"), latest("row", "header"))
    own = own.withColumns({"up_id": above, "first_id": F.lead("node_id").over(by)})
    down, self_, up_, next_ = ("up_id", "node_id"), ("node_id", "node_id"), ("node_id", "up_id"), ("node_id", "next_id")
    top, follows, filled = F.col("parent") == "document", F.col("next_id").isNotNull(), F.trim("text") != ""
    in_header = F.col("up_id").startswith("header")

    def edge(test: Column, name: str, ends: tuple[str, str]) -> Column:
        return F.when(test, F.struct(F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"), F.lit(name).alias("rel")))

    # a node meets the tests of its kind only
    belongs = edge(F.lit(True), "BELONGS_TO", up_)
    cells = [
        belongs, edge(F.lit(True), "HAS_CELL", down), edge(F.lit(True), "CELL_IN_ROW", up_), edge(F.col("in_column"), "CELL_IN_COLUMN", self_),
        edge(follows, "NEXT_COLUMN", next_), edge(follows, "PREVIOUS_COLUMN", next_[::-1]), edge(in_header & filled, "HEADER_FOR_COLUMN", self_),
    ]
    lines_ = [belongs, edge(F.lit(True), "HAS_ROW", down), edge(follows, "NEXT_ROW", next_), edge(follows, "PREVIOUS_ROW", next_[::-1]), edge((kind == "row") & filled, "ROW_HAS_LABEL", ("node_id", "first_id"))]
    sections_ = [belongs, edge(top, "HAS_SECTION", down), edge(top, "SECTION_IN_DOCUMENT", up_)]
    tables = [belongs, edge(F.lit(True), "HAS_TABLE", down), edge(F.lit(True), "TABLE_IN_SECTION", up_)]
    found = F.when(cell, F.array(*cells)).when(line, F.array(*lines_)).when(kind == "note", F.array(belongs, edge(F.lit(True), "REFERS_TO_NOTE", down))).when(kind == "section", F.array(*sections_)).when(kind == "table", F.array(*tables)).when(kind != "document", F.array(belongs))
    return own.select("doc_id", F.explode(F.array_compact(found)).alias("e")).select("doc_id", "e.*")
