"""Spark-first analytics engine for purchases, bank transactions and captured documents."""
