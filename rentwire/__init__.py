"""Spark jobs over lease comparables and market news."""
