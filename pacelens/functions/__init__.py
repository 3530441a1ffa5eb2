"""Shared column and frame helpers: NULL rules, ordered windows, exact statistics."""
