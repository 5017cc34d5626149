"""Spark-first engine that turns a topological object graph into feature tables."""
