"""Reading and writing corpora, and parsers of fetched bodies."""
