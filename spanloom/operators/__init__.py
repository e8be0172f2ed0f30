"""Relational, sequence and metric operators over trace tables."""
