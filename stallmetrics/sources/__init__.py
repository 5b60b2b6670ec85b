"""Readers of captured pages and of view counters."""
