"""wortlake: dictionary lookup, text analysis and data preparation on Spark DataFrames."""
