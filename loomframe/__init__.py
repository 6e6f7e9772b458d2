"""Analytics over axis-aligned data, planned as Spark DataFrames."""
