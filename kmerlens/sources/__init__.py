"""Readers and writers of sequence, interval and table files."""
