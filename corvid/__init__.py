"""corvid: code and text intelligence on Spark DataFrames."""
