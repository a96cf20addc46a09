"""Readers of scanner reports and advisory feeds, and writers."""
