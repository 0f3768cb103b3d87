"""Training-data operators: language, quality, near copies, search, tokens, licenses, lines and mixing."""
