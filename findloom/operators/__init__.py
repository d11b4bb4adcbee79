"""DataFrame operators: retrieval, ranking, neighbours, chunking, mutation, images and evaluation."""
