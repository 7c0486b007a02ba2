"""Reading and writing: graphs, embeddings, documents, triples."""
