"""Readers and writers of sheets and feeds."""
