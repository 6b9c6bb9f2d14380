"""Column -> Column expressions: text, URLs, quality, personal data, tokens, chunks."""
