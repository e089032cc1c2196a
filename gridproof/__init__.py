"""Validation, scoring and reconciliation of large asset collections as Spark DataFrame transformations."""
