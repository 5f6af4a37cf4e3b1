"""Composite plans, and the queries the driver runs."""
