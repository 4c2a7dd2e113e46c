"""glyphflow: page-text analytics on Spark DataFrames."""
