"""Scans, sinks and text-generation backends."""
