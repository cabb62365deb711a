"""Spark-first analytics for binary contracts quoted on two venues."""
