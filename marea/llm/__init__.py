"""Training-data operators: ten jobs over documents, pages and vectors. Nothing else in the library imports this."""
