"""Queries over the test tables, each with its SQL twin where SQL can say it."""
