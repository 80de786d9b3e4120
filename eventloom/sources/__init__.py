"""Scans and sinks. Paths and formats are arguments; object-store paths work as they are."""
