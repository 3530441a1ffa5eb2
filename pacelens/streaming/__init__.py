"""Incremental annotation work over file streams."""
