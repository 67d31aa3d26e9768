"""Incremental runs over file streams."""
