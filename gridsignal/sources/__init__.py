"""Scans, sinks and model storage."""
