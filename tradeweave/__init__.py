"""Network analytics over customs declarations, on Spark DataFrames."""
