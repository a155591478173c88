"""pointloom: point-cloud and corpus analytics on Spark DataFrames."""
