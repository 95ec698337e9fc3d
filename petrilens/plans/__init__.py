"""Queries: operators applied to the given tables, each with SQL for the same rows where SQL can express it."""
