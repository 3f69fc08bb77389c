"""Weftline: DataFrame operators for building, filtering, scoring and evaluating training data on Spark."""
