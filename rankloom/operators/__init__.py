"""Relational, ranking, recipe, metric, run-log and versioned-table operators."""
