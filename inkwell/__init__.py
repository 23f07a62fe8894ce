"""Editorial analytics warehouse on Spark DataFrames."""
