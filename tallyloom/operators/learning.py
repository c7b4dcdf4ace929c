"""Learned rules: aliases kept by the latest word, paths learned from corrected values, found again in new documents, and counted by success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyloom.functions.arrays import once, places
from tallyloom.operators import document_tree
from tallyloom.sources.shared import spread

#: A step of a path, from the document down.
STEP = "struct<type:string,label:string,col_index:int>"
#: Columns that say which rules a document may meet, where both tables have them.
SCOPES = ("template", "document_type", "scope")


def upsert_aliases(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """template, field, extracted_key and at: of each template's field the latest row of both tables; a null key deletes the rule."""
    latest = rules.unionByName(changes).groupBy("template", "field").agg(F.max_by(F.struct("extracted_key", "at"), F.struct("at", "extracted_key")).alias("r"))
    return latest.select("template", "field", "r.*").filter("extracted_key is not null")


def best_paths(rules: DataFrame) -> DataFrame:
    """Of each variable the rule with most successes, ties to the smaller rule_id."""
    by = Window.partitionBy("variable_name").orderBy(F.desc("success_count"), "rule_id")
    return rules.withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")


def learn_paths(nodes: DataFrame, examples: DataFrame) -> DataFrame:
    """Rules from corrected values: rule_id, template, variable_name, document_type, path and at.

    nodes: those of document_tree.nodes(docs, paths=True). examples: doc_id, template, variable_name,
    document_type (null: generic), key (the words that the value stands behind), value (null: the
    row itself is meant) and at (when it was said).

    An example's node is the first row whose label contains the key, else the first node of any kind
    whose text does; where a cell of that row equals the value, the first such cell with its column.
    The path down to it is the rule. Of several examples of one template's variable the latest that
    finds a node counts. Nodes and examples meet by document only; what is kept of a document is one
    node for each example.
    """
    by = ["doc_id", "template", "variable_name", "at"]
    wanted = _wanted(examples)
    own_label = F.lower(F.get("path", F.size("path") - 1)["label"])
    rank = F.when((F.col("node_type") == "row") & own_label.contains(F.col("words")), 0).when(F.lower("text").contains(F.col("words")), 1)
    said = (F.col("node_type") == "cell") & (F.col("value") != "") & (F.trim("text") == F.col("value"))
    # both what the words find and the cells that may be meant, in one pass
    hits = nodes.join(wanted, "doc_id").withColumns({"rank": rank, "said": F.coalesce(said, F.lit(False))}).filter("rank is not null or said")
    cell = F.struct("order", F.col("parent").alias("of"), "path", F.element_at(F.split("key", "/"), -1).cast("int").alias("col_no"))
    met = hits.groupBy(*by).agg(F.first("document_type").alias("document_type"), F.min_by(F.struct("key", "path"), F.when(F.col("rank").isNotNull(), F.struct("rank", "order"))).alias("best"), F.collect_list(F.when(F.col("said"), cell)).alias("cells"))
    first = F.get(F.array_sort(F.filter("cells", lambda c: c["of"] == F.col("best.key"))), F.lit(0))
    found = met.filter("best is not null").select(*by, "document_type", "best", first.alias("cell")).select(*by, "document_type", F.coalesce("cell.path", "best.path").alias("path"), "cell.col_no")
    return _rules(found)


def learn_from(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """The same as learn_paths, from documents (doc_id and text) in place of nodes: a document meets its examples as one row, and they are found in its tree there.

    Only documents with examples are parsed, and of a document only one path for each example is dealt out.
    """
    wanted = _wanted(examples).groupBy("doc_id").agg(F.collect_list(F.struct("template", "variable_name", "at", "document_type", "words", "value")).alias("examples"))
    met = document_tree.trees(spread(docs.select("doc_id", "text").join(wanted, "doc_id"), "doc_id"), paths=True)
    first = lambda test: F.get(F.filter("nodes", test), F.lit(0))
    label = lambda n: F.lower(F.get(n["path"], F.size(n["path"]) - 1)["label"])

    def found(e: Column) -> Column:
        best = F.coalesce(first(lambda n: (n["node_type"] == "row") & label(n).contains(e["words"])), first(lambda n: F.lower(n["text"]).contains(e["words"])))
        cell = lambda b: first(lambda n: (n["node_type"] == "cell") & (n["parent"] == b["key"]) & (e["value"] != "") & (F.trim(n["text"]) == e["value"]))
        told = lambda b: once(cell(b), lambda c: F.struct(e["template"], e["variable_name"], e["at"], e["document_type"], F.coalesce(c["path"], b["path"]).alias("path"), c["col_no"].alias("col_no")))
        return once(best, lambda b: F.when(b.isNotNull(), told(b)))

    each = met.select("doc_id", F.explode(F.filter(F.transform("examples", found), lambda x: x.isNotNull())).alias("e"))
    return _rules(each.select("doc_id", "e.*"))


def _wanted(examples: DataFrame) -> DataFrame:
    """Examples as they are looked for, one for each document, variable and time."""
    by = ["doc_id", "template", "variable_name", "at"]
    return examples.filter("trim(key) <> ''").select(*by, F.coalesce("document_type", F.lit("generic")).alias("document_type"), F.lower(F.trim("key")).alias("words"), F.trim("value").alias("value")).dropDuplicates(by)


def _rules(found: DataFrame) -> DataFrame:
    """Rules of the paths that examples (doc_id, template, variable_name, at, document_type, path and col_no) were found at."""
    last = F.size("path") - 1
    label = lambda s: F.when(s["label"].isNotNull(), s["label"]).when(s["type"].isin("paragraph", "heading", "note", "cell"), s["text"])
    steps = F.transform("path", lambda s, i: F.struct(s["type"].alias("type"), label(s).alias("label"), F.when(i == last, F.col("col_no")).alias("col_index")))
    made = found.select("template", "variable_name", "document_type", F.slice(steps, 2, last).cast(f"array<{STEP}>").alias("path"), "at", "doc_id").filter(F.size("path") > 0)
    latest = made.groupBy("template", "variable_name").agg(F.max_by(F.struct("document_type", "path", "at"), F.struct("at", "doc_id")).alias("r"))
    rule_id = F.sha2(F.concat_ws("\0", F.col("template").cast("string"), "variable_name"), 256)
    return latest.select(F.substring(rule_id, 1, 16).alias("rule_id"), "template", "variable_name", "r.document_type", "r.path", "r.at")


def shown_steps(path: Column) -> Column:
    """type[label] of each step, a cell with its column as cell#3."""
    step = lambda s: F.concat(s["type"], F.when(s["col_index"].isNotNull(), F.concat(F.lit("#"), s["col_index"].cast("string"))).otherwise(F.coalesce(F.concat(F.lit("["), s["label"], F.lit("]")), F.lit(""))))
    return F.array_join(F.transform(path, step), " > ")


def replay(nodes: DataFrame, rules: DataFrame, depth: int, strict_compat: bool = False) -> DataFrame:
    """doc_id, rule_id and the node (node_type, key, text, col_index) that a rule's path reaches in each document.

    nodes: those of document_tree.nodes(docs, paths=True). ``path`` is an array of steps with type,
    label and col_index, of which ``depth`` are taken at most. From the document down, a step goes to
    the first child of its type whose text or label contains the label; a step without a label takes
    the first of its type, a cell by its col_index. strict_compat: a cell step wants the label too. A
    path that finds no child gives no row.

    Where nodes and rules both have columns of SCOPES, a document meets the rules of its own only;
    else it meets all, which are one row. Every node is tested by itself against the step of its
    depth, and only nodes that fit, and whose ancestors may, are gathered; the walk goes through these.
    """
    by = [c for c in SCOPES if c in nodes.columns and c in rules.columns]
    taken = F.slice("path", 1, depth)
    rule = F.struct("rule_id", taken.cast(f"array<{STEP}>").alias("path"), F.transform(taken, lambda s: s["type"]).alias("types"))
    steps = rules.groupBy(*by).agg(F.collect_list(rule).alias("rules"))
    below = nodes.filter(F.size("path") > 1).withColumn("types", F.transform(F.slice("path", 2, 1000), lambda s: s["type"]))
    at = F.size("types")

    def says(step: Column, *texts: Column) -> Column:
        found = F.lit(False)
        for t in texts:
            found = found | F.coalesce(F.lower(t).contains(F.lower(step["label"])), F.lit(False))
        return F.coalesce(step["label"], F.lit("")).eqNullSafe("") | found

    def fits(step: Column) -> Column:
        labelled = says(step, F.col("text"), F.get("path", at)["label"])
        by_column = (F.col("node_type") == "cell") & step["col_index"].isNotNull()
        right = F.col("col_no") == step["col_index"]
        return F.when(by_column, (right & labelled) if strict_compat else right).otherwise(labelled)

    # of a longer text a path holds the beginning only, so that it may say more
    may = lambda s, step: says(step, s["text"], s["label"]) | (F.length(s["text"]) >= 80) | step["col_index"].isNotNull()
    above = lambda r: F.forall(F.zip_with(F.slice("path", 2, at - 1), F.slice(r["path"], 1, at - 1), may), lambda x: x)
    good = lambda r: (F.slice(r["types"], 1, at) == F.col("types")) & fits(F.get(r["path"], at - 1)) & above(r)
    met = below.join(steps, by) if by else below.crossJoin(steps)  # steps is one row
    hits = met.select("doc_id", "order", "node_type", "key", "parent", "text", at.alias("at"), F.explode(F.filter("rules", good)).alias("r"))
    node = F.struct("at", "order", "key", "parent", "node_type", "text")
    gathered = hits.groupBy("doc_id", "r.rule_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.first("r.path").alias("path"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("order"), F.lit("document").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit("document").alias("node_type"), F.lit("").alias("text"))
    down = lambda now, i: F.get(F.filter("nodes", lambda n: (n["at"] == i) & (n["parent"] == now["key"])), F.lit(0))
    end = F.aggregate(F.sequence(F.lit(1), F.size("path")), start, down)
    walked = gathered.select("doc_id", "rule_id", end.alias("n"), F.get("path", F.size("path") - 1)["col_index"].alias("col_index"))
    return walked.filter("n is not null").select("doc_id", "rule_id", "n.node_type", "n.key", "n.text", "col_index")


def replay_from(docs: DataFrame, rules: DataFrame, depth: int, strict_compat: bool = False) -> DataFrame:
    """The same as replay, from documents (doc_id, text and columns of SCOPES) in place of nodes: each rule walks through the tree in the document's row."""
    met = _met(docs, rules, F.struct("rule_id", F.slice("path", 1, depth).cast(f"array<{STEP}>").alias("path")))
    walked = lambda r: once(_end(r["path"], strict_compat), lambda n: F.struct(r["rule_id"], n["node_type"].alias("node_type"), n["key"].alias("key"), n["text"].alias("text"), F.get(r["path"], F.size(r["path"]) - 1)["col_index"].alias("col_index")))
    found = F.filter(F.transform("rules", walked), lambda n: n["key"].isNotNull())
    return met.select("doc_id", F.explode(found).alias("n")).select("doc_id", "n.*")


def _met(docs: DataFrame, rules: DataFrame, rule: Column) -> DataFrame:
    """doc_id, sections (of document_tree.parsed) and the rules that a document meets, dealt out by document."""
    by = [c for c in SCOPES if c in docs.columns and c in rules.columns]
    steps = rules.groupBy(*by).agg(F.collect_list(rule).alias("rules"))
    docs = docs.select("doc_id", "text", *by)
    return document_tree.parsed(spread((docs.join(steps, by) if by else docs.crossJoin(steps)).select("doc_id", "text", "rules"), "doc_id"))


def _end(path: Column, strict_compat: bool) -> Column:
    """The node that a path reaches in the row of a document with its sections, null if none.

    Only the children that a step asks for are looked at, in the order of document_tree.nodes; nodes
    that no step reaches are not made. A row's label needs no test of its own, as its text begins with it.
    """
    no_rows, none = F.lit(None).cast("array<array<string>>"), F.lit(None).cast("int")
    key = lambda kind, *c: F.concat_ws("/", F.lit(kind), *c)

    def node(kind: Column | str, name: Column, text: Column, section: Column = none, block: Column = none, rows: Column = no_rows, line: Column = none) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("node_type"), name.alias("key"), text.alias("text"), section.cast("int").alias("section"), block.cast("int").alias("block"), rows.alias("rows"), line.cast("int").alias("line"))

    def child(now: Column, step: Column) -> Column:
        says = lambda text: (F.coalesce(step["label"], F.lit("")) == "") | F.coalesce(F.lower(text).contains(F.lower(step["label"])), F.lit(False))
        first = lambda found, made: once(F.get(found, F.lit(0)), lambda x: F.when(x.isNotNull(), made(x)))
        blocks = lambda kind: F.filter(F.get(F.filter("sections", lambda s: s["section_no"] == now["section"]), F.lit(0))["blocks"], lambda b: b["kind"] == kind)
        rows, line = now["rows"], now["line"]

        section = first(F.filter("sections", lambda s: s["parent_no"].eqNullSafe(now["section"]) & says(s["title"])), lambda s: node("section", key("section", s["section_no"]), s["title"], s["section_no"]))
        heading = F.when(says(now["text"]), node("heading", key("heading", now["section"]), now["text"]))
        paragraph = first(F.filter(blocks("paragraph"), lambda b: (F.trim(b["content"]) != "") & says(b["content"])), lambda b: node("paragraph", key("paragraph", b["block_no"]), b["content"]))
        header = lambda t: F.array_join(F.get(t["rows"], F.lit(0)), " | ")
        tables = F.transform(blocks("table"), lambda b: F.struct(b["block_no"].alias("block_no"), document_tree.rows_of(b["lines"]).alias("rows")))
        table = first(F.filter(tables, lambda t: (F.size(t["rows"]) > 0) & says(header(t))), lambda t: node("table", key("table", t["block_no"]), header(t), block=t["block_no"], rows=t["rows"]))

        text_of = lambda i: F.array_join(F.filter(F.slice(F.get(rows, i), 1, 2), lambda v: F.trim(v) != ""), " | ")
        row = first(F.filter(places(rows), lambda i: (i > 0) & says(text_of(i))), lambda i: node("row", key("row", now["block"], i), text_of(i), block=now["block"], rows=rows, line=i))
        top = F.when(says(F.lit("")), node("header", key("header", now["block"]), F.lit(""), block=now["block"], rows=rows, line=F.lit(0)))

        own = F.get(rows, line)
        right = lambda c: F.when(step["col_index"].isNotNull(), ((c == step["col_index"]) & says(F.get(own, c))) if strict_compat else c == step["col_index"]).otherwise(says(F.get(own, c)))
        cell = first(F.filter(places(own), right), lambda c: node("cell", key("cell", now["block"], line, c), F.get(own, c)))
        notes = F.transform(document_tree.notes_of(F.get(rows, F.lit(0)), own), lambda n, j: F.struct(F.concat(F.lit("Note "), n).alias("text"), j.alias("j")))
        note = first(F.filter(notes, lambda n: says(n["text"])), lambda n: node("note", key("note", now["block"], line, n["j"]), n["text"]))

        to = lambda kind, *above: (step["type"] == kind) & now["node_type"].isin(*above)
        found = F.when(to("section", "document", "section"), section).when(to("heading", "section"), heading).when(to("paragraph", "section"), paragraph).when(to("table", "section"), table)
        return found.when(to("row", "table"), row).when(to("header", "table"), top).when(to("cell", "row", "header"), cell).when(to("note", "row"), note)

    return F.when(F.size(path) > 0, F.aggregate(path, node("document", F.lit("document"), F.lit("")), child))


def looks_numeric(text: Column) -> Column:
    """Digits only, but for commas, dots and hyphens."""
    return F.regexp_replace(text, "[,.-]", "").rlike(r"^\s*[0-9]+\s*$")


def value_of(node_type: Column, text: Column, cells: Column, col_index: Column) -> Column:
    """The value that a node states, empty if none.

    A cell states its text. Else, in this order: what stands behind the last colon (or, without one,
    the last spaced hyphen); the row's cell of this column, its last but one numeric cell, its only
    one, its last cell; of the numbers at the end of the text, with the words before them as column
    0, the one of this column, the last but one or the only one.
    """
    text = F.trim(F.coalesce(text, F.lit("")))
    parts = F.when(text.contains(":"), F.split(text, ":")).when(text.contains(" - "), F.split(text, " - "))
    behind = F.nullif(F.trim(F.element_at(parts, -1)), F.lit(""))

    def pick(from_: Column, numbers: Column) -> Column:
        within = col_index.isNotNull() & (col_index >= 0) & (col_index < F.size(from_))
        return F.when(within, F.get(from_, col_index)).when(F.size(numbers) > 1, F.try_element_at(numbers, F.lit(-2))).when(F.size(numbers) == 1, F.try_element_at(numbers, F.lit(-1)))

    trimmed = F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda x: F.trim(x))
    of_row = once(trimmed, lambda c: F.when(F.size(c) > 0, F.coalesce(pick(c, F.filter(c, looks_numeric)), F.when(F.size(c) > 1, F.try_element_at(c, F.lit(-1))))))

    def of_words(words: Column) -> Column:
        last_word = F.array_max(F.transform(words, lambda w, i: F.when(~looks_numeric(w), i + 1).otherwise(0)))
        numbers = F.slice(words, last_word + 1, F.size(words))
        label = F.when(last_word > 0, F.array(F.array_join(F.slice(words, 1, last_word), " "))).otherwise(F.array().cast("array<string>"))
        return once(numbers, lambda n: F.when(F.size(n) > 0, pick(F.concat(label, n), n)))

    at_end = once(F.filter(F.split(text, r"\s+"), lambda w: w != ""), of_words)
    return F.when(node_type == "cell", text).otherwise(F.coalesce(behind, of_row, at_end, F.lit("")))


def rejected(value: Column, variable: Column) -> Column:
    """Is this no value: a paragraph, the variable's own name, or an address of the web?"""
    low = F.lower(F.trim(value))
    paragraph = (F.length(value) > F.length(variable) + 20) & (F.size(F.split(F.trim(value), r"\s+")) > 5)
    return paragraph | (low == F.lower(F.trim(variable))) | low.rlike("^(www\\.|https?://)")


def _status() -> Column:
    return F.when(F.col("said").isNull(), "path lost").when(F.col("said") == "", "no value").when(rejected(F.col("said"), F.col("variable_name")), "rejected").otherwise("extracted")


def extract(nodes: DataFrame, rules: DataFrame, depth: int = 10, strict_compat: bool = False) -> DataFrame:
    """doc_id, rule_id, variable_name, value and status for every document and every rule of its scope.

    status: extracted; rejected (no value by the guards); no value (the node states none); path lost.
    All but extracted have a null value.
    """
    found = replay(nodes, rules, depth, strict_compat)
    cells = nodes.filter("node_type = 'cell'").select("doc_id", F.col("parent").alias("key"), "col_no", "text")
    of_rows = found.filter("node_type <> 'cell'").select("doc_id", "key").distinct().join(cells, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("cells"))
    said = found.join(of_rows, ["doc_id", "key"], "left").select("doc_id", "rule_id", value_of(F.col("node_type"), F.col("text"), F.col("cells.text"), F.col("col_index")).alias("said"))
    by = [c for c in SCOPES if c in nodes.columns and c in rules.columns]
    wanted = nodes.filter("node_type = 'document'").select("doc_id", *by)
    each = rules.groupBy(*by).agg(F.collect_list(F.struct("rule_id", "variable_name")).alias("rules"))
    wanted = (wanted.join(each, by) if by else wanted.crossJoin(each)).select("doc_id", F.explode("rules").alias("r")).select("doc_id", "r.*")
    judged = wanted.join(said, ["doc_id", "rule_id"], "left").withColumn("status", _status())
    return judged.select("doc_id", "rule_id", "variable_name", F.when(F.col("status") == "extracted", F.col("said")).alias("value"), "status")


def extract_from(docs: DataFrame, rules: DataFrame, depth: int = 10, strict_compat: bool = False) -> DataFrame:
    """The same as extract, from documents (doc_id, text and columns of SCOPES) in place of nodes: texts meet the rules, and each rule walks through the tree in the document's row.

    So neither nodes nor paths are made or dealt out.
    """
    met = _met(docs, rules, F.struct("rule_id", "variable_name", F.slice("path", 1, depth).cast(f"array<{STEP}>").alias("path")))

    def walked(r: Column) -> Column:
        cells = lambda n: F.coalesce(F.get(n["rows"], n["line"]), F.array().cast("array<string>"))
        told = lambda n: F.struct(r["rule_id"], r["variable_name"], n["node_type"].alias("node_type"), n["text"].alias("text"), F.when(n["node_type"] != "cell", cells(n)).alias("cells"), F.get(r["path"], F.size(r["path"]) - 1)["col_index"].alias("col_index"))
        return once(_end(r["path"], strict_compat), told)

    each = met.select("doc_id", F.explode(F.transform("rules", walked)).alias("r")).select("doc_id", "r.*")
    said = F.when(F.col("node_type").isNotNull(), value_of(F.col("node_type"), F.col("text"), F.col("cells"), F.col("col_index")))
    # the value is made once, by explode, and not again for each test of it
    made = each.select("doc_id", "rule_id", "variable_name", F.explode(F.array(said)).alias("said"))
    return made.withColumn("status", _status()).select("doc_id", "rule_id", "variable_name", F.when(F.col("status") == "extracted", F.col("said")).alias("value"), "status")


class RuleTable:
    """Rules under a folder, one partition for each template, and the successes of each run.

    Only the partitions of templates that change are written again. A run that is repeated replaces
    its own successes, so a rule counts what each run found once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rules_path, self.successes_path = spark, f"{path}/rules", f"{path}/successes"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def stored(self) -> DataFrame:
        return self._read(self.rules_path, f"rule_id string, variable_name string, document_type string, path array<{STEP}>, at timestamp, template string")

    def rules(self) -> DataFrame:
        """The rules with success_count, the rows that all runs recorded for them."""
        times = self._read(self.successes_path, "rule_id string, n long, run string").groupBy("rule_id").agg(F.sum("n").alias("success_count"))
        return self.stored().join(times, "rule_id", "left").na.fill({"success_count": 0})

    def upsert(self, learned: DataFrame) -> None:
        """Of each template's variable the rule said last. A rule that changes keeps its id and so its count."""
        columns = ["rule_id", "variable_name", "document_type", "path", "at", "template"]
        new = learned.select(*columns[:-1], F.col("template").cast("string"))
        touched = self.stored().join(new.select("template").distinct(), "template", "left_semi")
        latest = touched.select(columns).union(new.select(columns)).groupBy("template", "variable_name").agg(F.max_by(F.struct("rule_id", "document_type", "path", "at"), F.struct("at", "rule_id")).alias("r"))
        merged = latest.select("r.rule_id", "variable_name", "r.document_type", "r.path", "r.at", "template")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("template").parquet(self.rules_path)

    def record(self, extracted: DataFrame, run: str) -> None:
        """Count what a run extracted."""
        n = extracted.filter("status = 'extracted'").groupBy("rule_id").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
        n.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.successes_path)
