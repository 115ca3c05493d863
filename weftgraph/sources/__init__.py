"""Readers and writers of mesh files and partitioned table sets."""
