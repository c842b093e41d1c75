"""Whole jobs: bronze to silver indexing, and the shipped dashboards."""
