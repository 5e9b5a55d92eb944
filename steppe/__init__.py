"""Multi-script text analytics on Spark DataFrames."""
