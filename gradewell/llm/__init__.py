"""Operators for preparing training text, with their queries.

Nothing outside this folder imports it. Each operator takes DataFrames and
column names; ``queries`` binds them to the given tables.
"""
