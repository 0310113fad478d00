"""Relational operators: chunking, indexing, ranking, merging, near-duplicates, evaluation, crawling, generation."""
