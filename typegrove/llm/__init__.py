"""Training-data operators over a ``documents`` table; nothing else in the library imports this package."""
