"""Readers, sinks and the mapping from supplied tables to planning roles."""
