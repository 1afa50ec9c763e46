"""rankloom: recommendation analytics as plain Spark jobs.

Interactions, items and users come in as typed tables; popular items, similar
items, personal lists, cold items and user segments come out as ranked rows.
Everything is DataFrame code: Catalyst plans it and Spark partitions it.
"""
