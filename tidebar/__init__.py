"""tidebar: panels of time-ordered bars on Spark DataFrames."""
