"""Set-at-a-time community analytics on Spark DataFrames."""
