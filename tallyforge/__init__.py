"""Spark-first engine for curating and evaluating sets of machine-generated answers."""
