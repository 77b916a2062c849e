"""factloom: bitemporal fact analytics on Spark DataFrames."""
