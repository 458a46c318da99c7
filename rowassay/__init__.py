"""Declarative data quality on Spark: clean, profile, inject, validate, score, report."""

ROW_ID = "_row_id"
