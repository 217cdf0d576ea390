"""Relational operators: chunking, de-duplication, retrieval, fusion, catalog upkeep."""
