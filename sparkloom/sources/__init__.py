"""Readers and writers beyond those Spark has."""
