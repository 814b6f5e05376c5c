"""Adapter views over the test tables, the registered queries, and model hooks."""
