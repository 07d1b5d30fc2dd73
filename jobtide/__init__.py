"""Labour-market skill-demand analytics on Spark DataFrames."""
