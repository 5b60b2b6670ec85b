"""Marketplace analytics expressed as Spark DataFrame programs."""
