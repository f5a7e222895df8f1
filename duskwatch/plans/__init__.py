"""Registered queries, grouped by theme, each with its SQL twin where SQL can say it."""
