"""The stateless phases over streams of documents, and fresh vocabulary from them."""
