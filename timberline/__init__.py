"""Timberline: central log analytics expressed as PySpark DataFrame jobs."""
