"""Training-data operators: ten operators over documents, pages and embeddings. Nothing outside this folder imports them."""
