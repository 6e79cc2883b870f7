"""Readers, writers, the stored star schema and the bindings onto given tables."""
