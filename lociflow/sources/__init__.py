"""lociflow.sources."""
