"""Readers and writers of data sets."""
