"""gridloom: gridded-data analytics on Spark DataFrames."""
