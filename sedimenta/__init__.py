"""Layered data pipelines and training-data operators on plain Apache Spark."""
