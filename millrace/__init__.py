"""Millrace: automated, auditable preparation of tabular data on Spark."""
