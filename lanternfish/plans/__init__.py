"""Registered queries: each one a Spark plan plus, where SQL can say it, the same query as plain SQL."""
