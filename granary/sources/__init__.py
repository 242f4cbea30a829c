"""Readers, writers and the storage protocol."""
