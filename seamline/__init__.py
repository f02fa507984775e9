"""Seamline: inspection analytics as Spark DataFrame and SQL operators."""
