"""Relational operators of the search engine: index, filters, ranking, fusion, browsing."""
