"""Scans, generators, preprocessing and sinks."""
