"""Document-accessibility analytics on Spark DataFrames."""
