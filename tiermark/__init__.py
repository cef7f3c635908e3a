"""Hierarchical impact indicators (group h-index and what follows from it) as Spark jobs."""
