"""Query parsing and query plans."""
