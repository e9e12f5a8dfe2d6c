"""Emberwatch subpackage."""
