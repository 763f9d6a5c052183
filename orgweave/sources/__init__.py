"""Readers, writers, registries and caches."""
