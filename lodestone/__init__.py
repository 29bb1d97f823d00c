"""Document retrieval on Spark: chunking, trigram BM25, cosine search, rank fusion, incremental indexing."""
