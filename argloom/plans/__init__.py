"""Registered queries: operators bound to the given tables, each with SQL for the same result."""
