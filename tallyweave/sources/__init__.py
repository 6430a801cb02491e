"""Readers, vendor formats and writers."""
