"""Spark jobs for governed study evidence: quality, privacy, versioned tables, retrieval."""
