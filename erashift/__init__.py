"""Cross-era account analytics as Spark DataFrame jobs."""
