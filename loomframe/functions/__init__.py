"""Reductions, element-wise operations and the column rules they rest on."""
