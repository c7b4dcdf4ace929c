"""Queries over whole tables. Importing this package registers them."""

from tallyloom.plans import batches, cleaning, documents, evidence, flag_report, grid_inputs, learned, lookups, navigation, outlines, packs, prior, report_texts, returns, reviews, sheets, text_fields, workbooks
from tallyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "batches", "cleaning", "documents", "evidence", "flag_report", "grid_inputs", "learned", "lookups", "navigation", "outlines", "packs", "prior", "report_texts", "returns", "reviews", "sheets", "text_fields", "workbooks"]
