"""Readers and writers for fire tables, scene manifests and run history."""
