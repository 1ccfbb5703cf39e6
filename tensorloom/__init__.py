"""Sparse tensor analytics and corpus preparation as Spark DataFrame programs."""
