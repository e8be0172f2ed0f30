"""Readers and writers for trace corpora."""
