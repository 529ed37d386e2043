"""Readers and writers of records, artifacts and reports."""
