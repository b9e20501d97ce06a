"""lociflow.operators."""
