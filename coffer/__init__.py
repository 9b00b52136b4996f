"""Ledger analytics as Spark DataFrame operators."""
