"""Training-data operators: text and vector work on whole corpora. Nothing else in the library imports this."""
