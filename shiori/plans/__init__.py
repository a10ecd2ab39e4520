"""Compositions of operators: building an index, hybrid search, answering questions."""
