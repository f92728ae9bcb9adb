"""findwell: relevance search over document collections, as PySpark DataFrame plans."""
