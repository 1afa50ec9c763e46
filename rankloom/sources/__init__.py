"""Typed CSV import, snapshots, batch files and nested documents."""
