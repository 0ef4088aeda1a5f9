"""Tessella: analytics and machine-learning data processing as Spark DataFrame plans."""
