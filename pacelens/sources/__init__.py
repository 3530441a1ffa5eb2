"""Scans, sinks and stand-in adapters."""
