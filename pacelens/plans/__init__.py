"""End-to-end builds and the query catalogue."""
