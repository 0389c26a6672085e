"""Temporal analytics on Spark: cohorts, interval abstraction and temporal pattern mining."""
