"""Typed scalar expressions and aggregates over Spark columns."""
