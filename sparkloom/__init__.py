"""Code-graph, retrieval and corpus-preparation operators on Spark DataFrames."""
