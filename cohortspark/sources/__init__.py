"""Scans, sinks and scratch tables."""
