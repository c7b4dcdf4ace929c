"""Filings analytics as Spark jobs."""
