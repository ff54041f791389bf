"""A retrieval and graph analytics engine on Spark DataFrames."""
