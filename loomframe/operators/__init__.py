"""Operators on whole data sets: chains, views, copies, concatenation, reordering, reconstruction, contracts."""
