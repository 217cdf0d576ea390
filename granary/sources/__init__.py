"""Readers and writers: raw files, text trees, YAML-like configuration."""
