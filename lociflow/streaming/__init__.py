"""lociflow.streaming."""
