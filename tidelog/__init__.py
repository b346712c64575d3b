"""Analytics over append-only logs of collaborative edits, on Spark DataFrames."""
