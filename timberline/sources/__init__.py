"""Channels, templates and the daily-partitioned event store."""
