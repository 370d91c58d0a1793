"""Readers and writers of tracks."""
