"""Incremental processing of newly arriving files (availableNow file stream)."""
