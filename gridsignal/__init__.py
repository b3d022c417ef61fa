"""gridsignal: early-warning analytics on gridded fields and index series, on Spark DataFrames."""
