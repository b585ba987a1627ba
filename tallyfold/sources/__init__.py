"""Readers that turn files and streams into event records."""
