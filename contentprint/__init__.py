"""contentprint: content fingerprinting and hybrid retrieval on Spark DataFrames."""
