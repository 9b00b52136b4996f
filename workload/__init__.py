"""Queries over the TPC-H-like test tables, each with an independent SQL statement."""
