"""Queries over the test tables, each with its SQL counterpart where SQL can say the same."""
