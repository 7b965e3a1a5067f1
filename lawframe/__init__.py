"""Spark-first analytics over versioned legal documents and their citation graph."""
