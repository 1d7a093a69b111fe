"""Operators over DataFrames of deals, places and stories."""
