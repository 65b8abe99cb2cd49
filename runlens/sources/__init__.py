"""Readers, sinks, and adapters from plain tables."""
