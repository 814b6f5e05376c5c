"""Readers and writers of annotation files."""
