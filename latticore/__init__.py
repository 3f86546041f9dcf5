"""latticore: point-sweep analytics on Spark DataFrames."""
