"""Readers and writers of league tables."""
