"""boxframe: spatio-temporal annotation data on Spark DataFrames."""
