"""Sequence-structure analytics on Spark: DataFrame plans for symbol sequences."""
