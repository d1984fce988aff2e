"""Operators for preparing training data, each built on Spark jobs over whole tables."""
