"""lociflow.plans."""
