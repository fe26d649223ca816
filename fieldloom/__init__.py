"""fieldloom: declarative extraction and library analytics on Spark DataFrames."""
