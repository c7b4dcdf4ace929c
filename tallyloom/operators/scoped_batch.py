"""Batches of documents: each meets the rules of its type, and what no rule finds waits for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import comparison, learning, lookup
from tallyloom.sources.shared import saved

#: What a prediction says when it found nothing.
BAD = ("", "unknown", "n/a", "none", "null", "nan", "not found")
GENERIC = "generic"


def scopes(types: DataFrame, rules: DataFrame) -> DataFrame:
    """template, document_type, scope and tier: which rules a type of document meets: its own (tier 1), else the generic ones (2), else all of the template (3).

    types: template and document_type. rules: the same columns; an empty or null type is generic. A
    rule stands in the scope of its type and in the scope of all, so types and rules meet by scope.
    """
    kind = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(GENERIC))
    known = rules.select("template", kind(F.col("document_type")).alias("scope")).distinct()
    asked = types.select("template", kind(F.col("document_type")).alias("document_type")).distinct()
    own = asked.join(known.withColumnRenamed("scope", "document_type"), ["template", "document_type"], "left_semi").select("template", "document_type", F.col("document_type").alias("scope"), F.lit(1).alias("tier"))
    rest = asked.join(own, ["template", "document_type"], "left_anti")
    generic = known.filter(F.col("scope") == GENERIC).select("template", F.lit(2).alias("tier"))
    some = rules.select("template").distinct()
    others = rest.join(some, "template", "left_semi").join(generic, "template", "left").select("template", "document_type", F.when(F.col("tier").isNotNull(), GENERIC).otherwise("*").alias("scope"), F.coalesce("tier", F.lit(3)).alias("tier"))
    return own.union(others)


def scoped_rules(types: DataFrame, rules: DataFrame) -> DataFrame:
    """template, document_type, tier, form_field and extracted_key of all rules that each type of document meets."""
    kind = F.coalesce(F.nullif("document_type", F.lit("")), F.lit(GENERIC))
    each = rules.select("template", F.explode(F.array(kind, F.lit("*"))).alias("scope"), "form_field", "extracted_key")
    return scopes(types, rules).join(each, ["template", "scope"]).select("template", "document_type", "tier", "form_field", "extracted_key").distinct()


def best_rules(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """template, extracted_key, rule_id and path: of the template's learned rules whose variable contains the key the one of most successes, ties to the smaller rule_id."""
    low = lambda c: F.lower(F.trim(c))
    keys = wanted.select("template", "extracted_key", low(F.col("extracted_key")).alias("needle")).distinct()
    named = paths.select("template", "rule_id", "path", "success_count", low(F.col("variable_name")).alias("hay"))
    pairs = lookup.contained(keys.select(F.col("needle").alias("text")), named.select(F.col("hay").alias("text")), 4)
    met = keys.join(pairs, "needle").join(named, ["template", "hay"])
    best = met.groupBy("template", "extracted_key").agg(F.min(F.struct((-F.col("success_count")).alias("less"), "rule_id", "path")).alias("b"))
    return best.select("template", "extracted_key", "b.rule_id", "b.path")


def run_batch(docs: DataFrame, rules: DataFrame, paths: DataFrame, predictions: DataFrame) -> DataFrame:
    """doc_id, form_field, value, source and tier for each document and each rule that it meets.

    docs: doc_id, template, document_type and text. rules: template, document_type, form_field and
    extracted_key. paths: learned rules with success_count. predictions: doc_id, ord, key and value.
    source is path where a learned rule finds a value, else prediction where a predicted key stands
    for the field (by the tiers of cascade_match) and says something, else pending.
    """
    kind = F.coalesce(F.nullif("document_type", F.lit("")), F.lit(GENERIC))
    docs = docs.withColumn("document_type", kind)
    rules_of = saved(scoped_rules(docs.select("template", "document_type"), rules), "scoped")
    asked = docs.select("doc_id", "template", "document_type").join(rules_of, ["template", "document_type"])

    best = saved(best_rules(rules_of, saved(paths, "paths")), "best")
    learned = best.select("template", "rule_id", "path", F.col("extracted_key").alias("variable_name")).dropDuplicates(["template", "rule_id"])
    found = learning.extract_from(docs.select("doc_id", "template", "text"), learned).filter("status = 'extracted'").select("doc_id", "rule_id", F.col("value").alias("by_path"))
    asked = asked.join(best.select("template", "extracted_key", "rule_id"), ["template", "extracted_key"], "left").join(found, ["doc_id", "rule_id"], "left")
    asked = saved(asked.select("doc_id", "form_field", "tier", "by_path"), "asked")

    pending = asked.filter("by_path is null").select("doc_id", "form_field")
    sound = predictions.filter(F.col("value").isNotNull() & ~F.lower(F.trim("value")).isin(*BAD))
    pairs = comparison.match_pairs(sound.select("key").distinct(), pending.select(F.col("form_field").alias("field")).distinct())
    met = sound.join(pairs, "key").join(pending, [F.col("form_field") == F.col("field"), sound["doc_id"] == pending["doc_id"]]).select(sound["doc_id"], "form_field", "tier", "ord", "value")
    said = met.groupBy("doc_id", "form_field").agg(F.min_by("value", F.struct("tier", "ord")).alias("predicted"))
    out = asked.join(said, ["doc_id", "form_field"], "left")
    source = F.when(F.col("by_path").isNotNull(), "path").when(F.col("predicted").isNotNull(), "prediction").otherwise("pending")
    return out.select("doc_id", "form_field", F.coalesce("by_path", "predicted").alias("value"), source.alias("source"), "tier")


def batch_status(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, status and n_fields: review where a field is pending, else success; a document that meets no rule is a success without fields."""
    each = fields.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("source") == "pending").alias("waits"))
    return docs.select("doc_id").join(each, "doc_id", "left").select("doc_id", F.when(F.col("waits"), "review").otherwise("success").alias("status"), F.coalesce("n", F.lit(0)).alias("n_fields"))
