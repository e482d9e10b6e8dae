"""Scalar expressions as Spark columns."""
