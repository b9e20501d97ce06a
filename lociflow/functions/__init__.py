"""lociflow.functions."""
