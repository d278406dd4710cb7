"""Table-generating extractors: one source text to rows of symbols and imports."""
