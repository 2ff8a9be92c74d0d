"""Readers of what the operators work on."""
