"""Relational operators of the engine: rules, chunking, embedding, indexing, retrieval."""
