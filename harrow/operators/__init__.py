"""DataFrame operators: datasets, reranking, post-processing, metrics."""
