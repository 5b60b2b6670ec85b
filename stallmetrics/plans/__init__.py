"""Queries registered with the driver and their SQL equivalents."""
