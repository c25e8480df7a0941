"""Document analytics on Spark DataFrames: chunking, hybrid retrieval, annotations, citations and training-data operators."""
