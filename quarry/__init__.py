"""quarry: code-fact analytics on Spark DataFrames."""
