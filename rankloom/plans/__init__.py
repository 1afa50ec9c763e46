"""Canonical views on the test tables, the query catalogue and its check SQL."""
