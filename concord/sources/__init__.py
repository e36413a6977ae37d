"""Readers of records, results, similarity matrices and trajectory artifacts, and writers of results."""
