"""Manuscript-corpus analytics and training-data preparation on Apache Spark."""
