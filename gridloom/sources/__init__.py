"""Readers, writers and simulated sources."""
