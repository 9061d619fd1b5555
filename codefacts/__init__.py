"""Source-code facts, graph and search jobs on Spark DataFrames."""
